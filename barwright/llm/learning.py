"""What both text classifiers share: the labelled sample, the fit in one task, scores as columns."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from barwright.llm import shared

#: Labelled documents that a model is fitted on, at most; those of least hash of their id.
SAMPLE_ROWS = 20_000
#: UTF-8 bytes of a sample's texts together, and of the longest text that is learnt from: what the one
#: task that fits a model holds is bounded by bytes, not only by rows.
SAMPLE_BYTES, LONGEST_BYTES = 96 << 20, 1 << 20


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, bound: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text",
    sample_bytes: int | None = None, longest_bytes: int | None = None,
) -> DataFrame:
    """(t, y): at most ``bound`` texts that have a label and aren't held out.

    A document labelled more than once counts with its greatest label; one that stands there more than
    once counts with its least text. Texts beyond ``longest_bytes`` are scored but not learnt from; the
    sample ends where its texts reach ``sample_bytes`` (None: LONGEST_BYTES and SAMPLE_BYTES). The ids are bounded, so they are broadcast.
    """
    sample_bytes = SAMPLE_BYTES if sample_bytes is None else sample_bytes
    longest_bytes = LONGEST_BYTES if longest_bytes is None else longest_bytes
    order = [F.xxhash64("_id"), "_id"]
    ids = (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~shared.held_out(id_col))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(*order)
        .limit(bound)
    )
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    some = rows.where(F.octet_length("t") <= longest_bytes).join(F.broadcast(ids), "_id").groupBy("_id", "y").agg(F.min("t").alias("t"))
    some = shared.stored(some)
    so_far = F.sum(F.octet_length("t")).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    within = some.select("_id", so_far.alias("_sum")).where(F.col("_sum") <= sample_bytes).select("_id")
    return some.join(F.broadcast(within), "_id", "left_semi").select("t", "y")


def fit(sample: DataFrame, features: Callable[[str], np.ndarray], train: Callable, owner: str) -> object:
    """The model that ``train(list of feature arrays, labels)`` returns; None without any row."""
    found = fit_parts(sample, features, lambda rows, y, _: train(rows, y), 1, owner)
    return found[0] if found else None


def fit_parts(sample: DataFrame, features: Callable[[str], np.ndarray], train: Callable, parts: int, owner: str) -> list:
    """What ``train(list of feature arrays, labels, k)`` returns for each k below ``parts``; empty without any row.

    Features are computed where the texts are; only they meet in the parts' tasks, and the sample bounds them.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.remember_only(owner)
        for b in batches:
            found = [features(t.as_py()).tobytes() for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), b.column(1)], names=["f", "y"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for b in batches:
            for k, f, y in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                held.setdefault(k, ([], []))[0].append(f.as_py())
                held[k][1].append(y)
        for k in sorted(held):
            found, y = held.pop(k)
            order = sorted(range(len(y)), key=lambda i: (found[i], y[i]))  # the same model in any order of arrival
            rows = [np.frombuffer(found[i], dtype=np.uint32) for i in order]
            model = pickle.dumps(train(rows, np.array([y[i] for i in order]), k))
            del found, y, rows, order
            shared.give_back()
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([model], pa.binary())], names=["k", "m"])

    made = sample.mapInArrow(extract, "f binary, y int").select(F.explode(F.array(*map(F.lit, range(parts)))).alias("k"), "f", "y")
    # many more partitions than parts, so that two parts rarely meet in one
    dealt = made.repartition(1 if parts == 1 else 16 * parts, "k")
    got = dealt.mapInArrow(learn, "k int, m binary").collect()  # a few models
    return [pickle.loads(m) for _, m in sorted((r["k"], r["m"]) for r in got)]


def scored(docs: DataFrame, score: Callable[[str], float], id_col: str, text_col: str, cut: float, owner: str) -> DataFrame:
    """Per row: id, held_out, score, predicted (1 from ``cut`` on). Null texts score like empty ones."""
    shared.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.remember_only(owner)
        for b in batches:
            s = [float(score(t.as_py())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return given.mapInArrow(run, f"id {kind}, score double").select(
        F.col("id").alias(id_col),
        shared.held_out("id").alias("held_out"),
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )


def kept_where(docs: DataFrame, score: Callable[[str], float], text_col: str, keep: Callable[[float], bool], owner: str) -> DataFrame:
    """The rows of docs, all columns as they are, whose text's score is to be kept."""
    shared.small_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def good(texts):
        shared.remember_only(owner)
        return texts.map(lambda t: keep(score(t)))

    return docs.where(good(F.coalesce(F.col(text_col), F.lit(""))))


def sigmoid(x: float) -> float:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def platt(margins: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(a, b) so that sigmoid(a * margin + b) is the chance of label 1: Newton steps on smoothed targets."""
    n1, n0 = (y == 1).sum(), (y != 1).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 0.0, np.log((n1 + 1) / (n0 + 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        g, d = p - target, p * (1 - p) + 1e-9
        ga, gb = (g * margins).sum() + 1e-3 * a, g.sum()
        haa, hab, hbb = (d * margins**2).sum() + 1e-3, (d * margins).sum(), d.sum()
        det = haa * hbb - hab**2
        if det <= 0:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-8:
            break
    return float(a), float(b)

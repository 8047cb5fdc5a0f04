"""Chat formatting over reply trees.

Messages name the message they reply to. Iterative self-joins double the reach of every message's
pointer towards its root, adding up scores on the way, so a tree of depth n takes log2(n) joins; leaves
are then ranked by the score of their whole branch, and the chosen branches' messages are enumerated by
the same pointers. Each chosen path becomes one text with a loss mask over the assistant's words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from barwright.llm import shared

#: Control strings of the template; fixed values.
TURN, BODY, END_BODY, END_TURN = "<s>", "[INST]", "[/INST]", "</s>"
_CONTROL = re.compile(r"([<\[])(\\*)(/?(?:s>|INST\]))")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?(?:s>|INST\]))")
_TURN = re.compile(r"<s>(.*?)\[INST\](.*?)\[/INST\]</s>", re.DOTALL)


def escape(text: str) -> str:
    """A backslash goes into every control string, and one more into those that have some."""
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text, and the spans (code points) that the loss covers."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{BODY}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END_BODY, END_TURN]
        at += len(head) + len(body) + len(END_BODY) + len(END_TURN)
    return "".join(parts), spans


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    return [(unescape(a), unescape(b)) for a, b in _TURN.findall(text)]


def branches(nodes: DataFrame, top: int = 1) -> DataFrame:
    """The best ``top`` root-to-leaf paths of each tree: (tree, leaf, branch_score, rank, node, up).

    ``nodes`` has tree, node, parent (null for a root) and score. A parent that isn't in the tree counts
    as none. ``up`` is the distance from the leaf. Ties go to the lesser leaf. Messages that reply to
    each other in a circle have no leaf or root and are left out.
    """
    key = ["tree", "node"]
    known = nodes.select("tree", F.col("node").alias("jump"))
    jump = shared.stored(
        nodes.select("tree", "node", F.col("parent").alias("jump"), F.coalesce("score", F.lit(0.0)).alias("total"))
        .join(known.withColumn("there", F.lit(True)).distinct(), ["tree", "jump"], "left")
        .select("tree", "node", F.when(F.col("there"), F.col("jump")).alias("jump"), "total")
    )
    replied = jump.where("jump is not null").select("tree", F.col("jump").alias("node")).distinct()
    leaves = jump.join(replied, key, "left_anti").select(*key)
    # messages whose pointer has passed the root are done; only the others go on doubling
    done, hops, most = jump.where("jump is null"), [jump.where("jump is not null")], jump.count()
    while (1 << (len(hops) - 1)) <= most and not hops[-1].isEmpty():
        now = hops[-1].unionByName(done)
        above = now.select("tree", F.col("node").alias("jump"), F.col("jump").alias("next"), F.col("total").alias("more"))
        further = shared.stored(
            hops[-1].join(above, ["tree", "jump"]).select(*key, F.col("next").alias("jump"), (F.col("total") + F.col("more")).alias("total"))
        )
        done = done.unionByName(further.where("jump is null"))
        hops.append(further.where("jump is not null"))
    best = W.partitionBy("tree").orderBy(F.col("total").desc(), "node")
    chosen = (
        leaves.join(done, key)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top)
        .select("tree", F.col("node").alias("leaf"), F.col("total").alias("branch_score"), "rank")
    )
    paths = shared.stored(chosen.withColumn("node", F.col("leaf")).withColumn("up", F.lit(0)))
    for k, hop in enumerate(hops[:-1]):
        further = paths.join(hop.select(*key, "jump"), key).select(
            "tree", "leaf", "branch_score", "rank", F.col("jump").alias("node"), (F.col("up") + (1 << k)).alias("up")
        )
        paths = paths.unionByName(shared.stored(further))
    return paths


def format_trees(messages: DataFrame, top: int = 1) -> DataFrame:
    """One row per chosen path: tree, leaf, branch_score, rank, formatted, loss_spans.

    ``messages`` has tree, node, parent, role, text, score; null roles and texts count as empty.
    """
    paths = branches(messages, top)
    turns = (
        paths.join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
        .groupBy("tree", "leaf", "branch_score", "rank")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct((-F.col("up")).alias("k"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
                )
            ).alias("turns")
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [render([(t["role"], t["text"]) for t in row.as_py()]) for row in b.column("turns")]
            spans = pa.array([[{"start": s, "end": e} for s, e in x] for _, x in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            texts = pa.array([t for t, _ in out], pa.string())
            keep = [b.column(n) for n in ("tree", "leaf", "branch_score", "rank")]
            yield pa.RecordBatch.from_arrays([*keep, texts, spans], names=["tree", "leaf", "branch_score", "rank", "formatted", "loss_spans"])

    types = dict(turns.dtypes)
    head = ", ".join(f"{n} {types[n]}" for n in ("tree", "leaf", "branch_score", "rank"))
    return turns.mapInArrow(run, f"{head}, formatted string, loss_spans array<struct<start: bigint, end: bigint>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """What formatted rows hold, read from their text and mask alone: digests per conversation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans in zip(b.column("formatted").to_pylist(), b.column("loss_spans").to_pylist()):
                turns = parse(text)
                said = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                every = "".join(f"{role}\n{words}\n" for role, words in turns)
                rows.append((len(turns), _hex(every), len(said), _hex(said), len(text)))
            n, all_hex, chars, said_hex, size = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column("tree"), pa.array(n, pa.int64()), pa.array(all_hex, pa.string()), pa.array(chars, pa.int64()), pa.array(said_hex, pa.string()), pa.array(size, pa.int64())],
                names=["tree", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    kind = dict(formatted.dtypes)["tree"]
    return formatted.select("tree", "formatted", "loss_spans").mapInArrow(
        run, f"tree {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def threads(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as trees of one branch: each turn replies to the one before.

    Turns that tie are ordered by role and text. A null conv_id is one conversation of its own.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("node")).select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("tree"),
        "node",
        F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Digests of every conversation formatted, by conv_id; null roles and texts count as empty.

    Repeated rows are turns of their own, as are turns of equal number; texts of any length are formatted
    whole, a conversation being one string. An empty table has no conversations; other columns, whatever
    their names, are ignored. formatted_chars counts the code points of the formatted text, escapes and
    template included.
    """
    back = read_back(format_trees(threads(conversations)))
    return back.select(F.when(F.col("tree") != "null", F.col("tree").cast("long")).alias("conv_id"), *back.columns[1:])

"""Helpers that several operators use: scratch tables, text columns, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows and bytes of one Arrow batch that holds whole texts, at most (one text beyond that is a batch).
TEXT_BATCH_ROWS, TEXT_BATCH_BYTES = "1000", str(64 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name below the shared folder named by spark.checkpoint.dir.

    Where none is named, a local master's only machine shares its own temporary folder with all of its
    threads, so one is made there; with any other master that would be another folder on every machine,
    and it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="barwright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/barwright-{uuid.uuid4().hex}"


def stored(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """The rows of df from a Parquet table in the shared folder: computed once, lineage cut there.

    A lost executor costs nothing that was stored, since every executor reads the same files.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts small enough for a Python worker.

    The options hold for the session, since they are read when a query runs, after an operator returned.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", TEXT_BATCH_BYTES)


def text_bytes(column: str = "text"):
    """The UTF-8 bytes of a text column; null counts as the empty text."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


#: By operator, what this Python worker remembers for it.
_REMEMBERED: dict[str, list] = {}


def remembered(owner: str, *caches) -> None:
    _REMEMBERED.setdefault(owner, []).extend(caches)


def remember_only(owner: str) -> None:
    """Called as a task begins: what the worker remembers for other operators is dropped."""
    for name, caches in _REMEMBERED.items():
        if name != owner:
            for c in caches:
                c.clear()
    give_back()


def give_back() -> None:
    """Returns memory that this worker has freed to the machine; workers live on for the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of the documents whose labels no model may see; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("u", "v")).alias("x"),
    ).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph: (node, root), root being the least node reachable.

    ``edges`` has two long columns, u and v. Nodes in no edge are left out. Large-star and small-star
    steps alternate until the edges stand still; each is one minimum by key, combined before its
    shuffle, joined back to the edges, so no node's neighbours are gathered in one place and adaptive
    execution can split a hub's join. Each round is stored in the shared folder; only a count and a
    checksum come to the driver.
    """
    edges = stored(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    seen = _fingerprint(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = (
            both.where("v > u")
            .join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("u"), F.col("m").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                )
            ).alias("e")
        )
        edges = stored(small.select("e.u", "e.v").where("u <> v").distinct())
        now = _fingerprint(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)

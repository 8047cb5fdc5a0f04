"""The corpus pipeline: stages over documents, each written as Parquet and read again.

STAGES, in order: toxicity (documents that it rejects go), quality (documents that it rejects go),
near_dedup (one document of each group stays, groups being the components of SimHash links and of
five-word Jaccard similarities of 0.8 or more), packing (one row per piece of the kept documents, with its
slot). All stages but the last return the columns of their input; they keep null ids, repeated rows (but
for near_dedup, which keeps one of a kind), and columns of any name, and an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from barwright.llm import fm, nbsvm, packing, shared, simhash


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scoring below 0.5; null texts count as empty and stay."""
    return fm.keep_civil(docs, shared.table(spark, sf_dir, "labels"), 0.5)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scoring 0.3 or more; null and empty texts score like texts without words."""
    return nbsvm.keep_good(docs, shared.table(spark, sf_dir, "labels"), 0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the least doc_id (nulls last), then
    text hash. Null and empty texts are copies of one another."""
    return simhash.keep_one(docs, similar=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Slots of the documents' pieces in sequences of 2048 tokens; null texts are the end token alone,
    repeated rows and null ids are packed like others."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_dedup", near_dedup), ("packing", pack)]

#: Scores, fingerprints and token ids aren't expressible in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = shared.stored(stage(spark, docs, sf_dir))
    return docs

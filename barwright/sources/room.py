"""Folders that the driver and all executors share, and small tables kept there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def room(spark: SparkSession, name: str = "room") -> str:
    """A new folder below the one that spark.checkpoint.dir names.

    Where none is named, a local master has its one machine's temporary folder; with any other master
    that would be another folder on every machine, and it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="barwright-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df from a table in a shared folder: computed once, however often it is read from there."""
    spark = df.sparkSession
    path = room(spark, "kept")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

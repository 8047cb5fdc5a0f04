"""Reading and writing the lake: partitioned bars, CSV with a mapping, archived column blocks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from barwright.functions.scalar import to_number
from barwright.operators import quality

#: Names under which sources have the columns of a bar, in order of preference; fixed values.
BAR_NAMES = {
    "ts": ["end", "timestamp", "datetime", "ts", "dt", "date"],
    "open": ["open", "pr_open", "o"],
    "high": ["high", "pr_high", "h"],
    "low": ["low", "pr_low", "l"],
    "close": ["close", "pr_close", "c"],
    "volume": ["volume", "vol", "v"],
}


@dataclass(frozen=True)
class TableContract:
    """A dataset's name, schema, key, partitions and version."""

    name: str
    schema: T.StructType
    key: list[str]
    partitions: list[str] = field(default_factory=list)
    version: str = "1"

    def missing(self, df: DataFrame) -> list[str]:
        return [f.name for f in self.schema.fields if f.name not in df.columns]


def scan_bars(spark: SparkSession, root: str, where: Column | None = None, lineage: bool = False) -> DataFrame:
    """A partitioned dataset; conditions on partition columns prune folders before anything is read."""
    df = spark.read.option("mergeSchema", "false").parquet(root)
    if lineage:
        df = df.withColumn("source_file", F.col("_metadata.file_path"))
    return df if where is None else df.where(where)


def write_partitioned(df: DataFrame, root: str, key: list[str], partitions: list[str], order: list[str]) -> None:
    """One row per key (the last in order), each partition's rows in one sorted file per task; only the
    partitions present are replaced."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*key).orderBy(*(F.desc(c) for c in order))
    last = df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    (
        last.repartition(*partitions).sortWithinPartitions(*partitions, *key)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(root)
    )


def resolve(df: DataFrame, names: dict[str, list[str]] = BAR_NAMES, required: tuple[str, ...] = ("open", "high", "low", "close")) -> DataFrame:
    """Columns under their usual names, found among the candidates whatever their case."""
    have = {c.lower(): c for c in df.columns}
    found = {k: next((have[n] for n in options if n in have), None) for k, options in names.items()}
    lacking = [k for k in required if found.get(k) is None]
    if lacking:
        raise quality.CheckFailed(f"missing_source_columns: {', '.join(lacking)}")
    return df.select(*(F.col(f"`{c}`").alias(k) for k, c in found.items() if c))


def read_ohlc_csv(spark: SparkSession, path: str, mapping: dict[str, str], sep: str = ",", ts_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Bars from CSV: ``mapping`` names the file's column for each of ts, open, high, low, close, volume."""
    unknown = set(mapping) - set(BAR_NAMES)
    if unknown:
        raise quality.CheckFailed(f"unknown_mapping_keys: {', '.join(sorted(unknown))}")
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    ts = F.try_to_timestamp(F.col(mapping["ts"]), F.lit(ts_format)).alias("ts")
    return raw.select(ts, *(to_number(v).alias(k) for k, v in mapping.items() if k != "ts"))


def column_blocks(payloads: DataFrame, column: str, blocks: list[str]) -> DataFrame:
    """Rows of archived answers {block: {columns: [...], data: [[...]]}}: (block, n, row map), from the
    first of the named blocks that has data. Pages are rows of the input."""
    shape = "map<string, struct<columns: array<string>, data: array<array<string>>>>"
    df = payloads.withColumn("_p", F.from_json(column, shape))
    options = F.array(*(F.struct(F.lit(b).alias("block"), F.col("_p")[b].alias("t")) for b in blocks))
    first = F.get(F.filter(options, lambda o: F.size(o["t"]["data"]) > 0), F.lit(0))
    one = df.withColumn("_b", first).where("_b is not null")
    return one.select("_b.block", "_b.t.columns", F.posexplode("_b.t.data").alias("n", "_d")).select(
        "block", "n", F.map_from_arrays("columns", "_d").alias("row")
    )


def create_lake(df: DataFrame, root: str, day: str) -> None:
    """A table kept by month, whose months can be replaced together in one step (see refresh_tail)."""
    _publish(df, root, day, [])


def read_lake(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the months in force, with the column month; a condition on it reads those months only."""
    months = _months(spark, root)
    if not months:
        raise quality.CheckFailed(f"empty_lake: {root}")
    paths = [f"{root}/version={v}/month={m}" for m, v in months]
    return spark.read.option("basePath", root).option("mergeSchema", False).parquet(*paths).drop("version").withColumn("month", F.col("month").cast("string"))


def _months(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """(month, version) of the months in force, by the last manifest: a row per state of the table."""
    states = spark.read.schema("state long, months array<struct<month: string, version: string>>").parquet(f"{root}-manifest")
    last = states.agg(F.max_by("months", "state").alias("m")).first()["m"]
    return [(r["month"], r["version"]) for r in last or []]


def _publish(df: DataFrame, root: str, day: str, kept: list[tuple[str, str]], state: int = 0) -> None:
    from uuid import uuid4

    spark, version = df.sparkSession, uuid4().hex
    path = f"{root}/version={version}"
    months = df.drop("month").withColumn("month", F.date_format(day, "yyyy-MM"))
    months.repartition("month").write.partitionBy("month").parquet(path)
    new = [] if df.isEmpty() else [r["month"] for r in spark.read.parquet(path).select(F.col("month").cast("string").alias("month")).distinct().collect()]
    table = [(state, sorted([*kept, *((m, version) for m in new)]))]
    spark.createDataFrame(table, "state long, months array<struct<month: string, version: string>>").coalesce(1).write.mode("append").parquet(f"{root}-manifest")


def refresh_tail(spark: SparkSession, root: str, tail: DataFrame, day: str, cutoff: str, key: list[str]) -> None:
    """Days from the cutoff on replaced by the tail's, in a table made by create_lake.

    Rows before the cutoff stay as they are, and months before the cutoff's keep their files. The cutoff's month
    and the tail's are written beside them; one row of the manifest then puts them in force together, so a reader
    sees the table before or after, whole. Months from the cutoff's on that the tail doesn't have go. Of tail rows
    that repeat a key the greatest counts; tail rows before the cutoff are ignored. One writer at a time.
    """
    states = spark.read.schema("state long").parquet(f"{root}-manifest")
    state, months = states.agg(F.max("state")).first()[0], _months(spark, root)
    kept = [(m, v) for m, v in months if m < cutoff[:7]]
    at = F.lit(cutoff).cast("date")
    new = tail.where(F.col(day) >= at)
    rest = [c for c in new.columns if c not in key]
    last = new.groupBy(*key).agg(F.max(F.struct(*rest)).alias("_l")).select(*key, *(F.col(f"_l.{c}").alias(c) for c in rest)).select(*new.columns)
    if any(m == cutoff[:7] for m, _ in months):
        early = read_lake(spark, root).where((F.col("month") == cutoff[:7]) & (F.col(day) < at)).drop("month")
        last = early.unionByName(last.drop("month"))
    _publish(last, root, day, kept, state + 1)


def guarded_swap(spark: SparkSession, candidate: DataFrame, root: str, name: str, ts: str) -> bool:
    """Takes a candidate as the table's next version, unless it is empty or ends earlier than the present.

    Versions are folders below root/name; a row of the table root/name-current names the one in force, so
    readers see the old or the new one, whole. Says whether the candidate was taken.
    """
    from uuid import uuid4

    version = uuid4().hex
    candidate.write.parquet(f"{root}/{name}/{version}")
    new = spark.read.schema(candidate.schema).parquet(f"{root}/{name}/{version}")
    old = current(spark, root, name, candidate.schema)
    if old is not None and not quality.may_replace(new, old, ts) or old is None and new.isEmpty():
        return False
    spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("at")).write.mode("append").parquet(f"{root}/{name}-current")
    return True


def current(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame | None:
    """The table's version in force, or None before the first."""
    try:
        versions = spark.read.schema("version string, at timestamp").parquet(f"{root}/{name}-current")
    except Exception as gone:  # the reader's class for a missing path differs between Spark's interfaces
        if "PATH_NOT_FOUND" in str(gone):
            return None
        raise
    last = versions.orderBy(F.desc("at")).limit(1).first()
    return spark.read.schema(schema).parquet(f"{root}/{name}/{last['version']}") if last else None


def unique_names(names: list[str]) -> list[str]:
    """c, c#2, c#3 for repeated names."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}#{seen[n]}")
    return out


def select_existing(df: DataFrame, names: list[str], prefixes: tuple[str, ...] = ()) -> DataFrame:
    """The named columns that exist, then those with one of the prefixes."""
    first = [n for n in names if n in df.columns]
    return df.select(*first, *(c for c in df.columns if c not in first and c.startswith(prefixes))) if prefixes else df.select(*first)


def append_registry(row: DataFrame, path: str) -> None:
    """Adds an experiment's row to the registry table."""
    row.write.mode("append").parquet(path)


#: What each timeframe of the read interface is resampled from.
TIMEFRAMES = ("5m", "15m", "30m", "1h", "4h", "D1")


def load_bars(bars: DataFrame, timeframe: str, start, end, columns: list[str] | None = None, key: str = "instrument", ts: str = "bar_end") -> DataFrame:
    """The read interface: checks the timeframe and the columns, filters by time, resamples, sorts."""
    from barwright.operators.bars import resample

    if timeframe not in TIMEFRAMES:
        raise quality.CheckFailed(f"unsupported_timeframe: {timeframe}")
    some = date_range(bars, ts, start, end)
    if timeframe != "5m":
        some = resample(some, "1d" if timeframe == "D1" else timeframe, key, ts)
    if columns is not None:
        unknown = [c for c in columns if c not in some.columns]
        if unknown or len(set(columns)) != len(columns):
            raise quality.CheckFailed(f"bad_columns: {', '.join(unknown) or 'repeated'}")
    some = some.orderBy(key, ts)
    return some if columns is None else some.select(*columns)


def date_range(df: DataFrame, ts: str, start: str | None, end: str | None) -> DataFrame:
    """Inclusive bounds; an end without a time of day means all of that day."""
    kind = dict(df.dtypes)[ts]
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start).cast(kind))
    if end is not None:
        edge = F.lit(end).cast(kind)
        df = df.where(F.col(ts) < edge + F.expr("interval 1 day")) if len(end) == 10 and kind != "date" else df.where(F.col(ts) <= edge)
    return df

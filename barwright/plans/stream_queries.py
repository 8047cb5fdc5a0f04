"""Queries that run a stream over the events to its end and return what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwright.plans.joins_queries import ema_sql
from barwright.plans.registry import query, rounded
from barwright.sources import views
from barwright.sources.room import kept, room as _room
from barwright.sources.views import sql
from barwright.streaming import bars as sb, merge as sm


#: Rows of one span of time that a batch takes, and the files that a span is written as.
SPAN_ROWS, SPAN_FILES = 2_000_000, 8


def _in_order(df, ts, path):
    """df as files that appear one span of time after the other, oldest first: four spans at least, each
    of some SPAN_ROWS rows at most and in SPAN_FILES files, dealt by time ranges."""
    rows, a, b = df.agg(F.count(F.lit(1)), F.min(ts), F.max(ts)).first()
    spans = max(4, -(-rows // SPAN_ROWS))
    for k in range(spans):
        lo, hi = a + (b - a) / spans * k, a + (b - a) / spans * (k + 1)
        some = df.where((F.col(ts) >= lo) & ((F.col(ts) < hi) if k < spans - 1 else F.lit(True)))
        some.repartitionByRange(SPAN_FILES, ts).write.mode("append").parquet(path)


def _ticks(events):
    return events.select(
        F.col("event_type").alias("instrument"), "ts", F.col("value").alias("price"), F.lit(1).cast("long").alias("qty"), F.col("value").alias("turnover"), F.col("event_id").alias("trade_id"), "user_id"
    )


def _stream(spark, sf_dir, repeat=None, late=None, flush=False):
    """events as a stream of ticks, one span per batch. ``repeat`` says which rows stand there twice;
    ``late`` which come once more at the end, under other ids and with other prices; a last row far ahead
    (instrument ~) lets the watermark pass all others."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    room = _room(spark)
    _in_order(raw if repeat is None else raw.unionByName(raw.where(repeat)), "ts", f"{room}/in")
    if late is not None:
        raw.where(late).withColumn("event_id", -F.col("event_id") - 1).withColumn("value", F.col("value") + 1000).write.mode("append").parquet(f"{room}/in")
    if flush:
        end = raw.agg((F.max("ts") + F.expr("interval 90 days")).alias("ts"))
        values = {"event_id": F.lit(-(2**62)), "user_id": F.lit(0), "event_type": F.lit("~"), "value": F.lit(0.0)}
        end.select(*(F.col("ts") if f.name == "ts" else values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in raw.schema)).write.mode("append").parquet(f"{room}/in")
    return _ticks(sb.tick_stream(spark, f"{room}/in", raw.schema, SPAN_FILES)), room


def _written(spark, stream, room, mode="append", name="out"):
    sb.run_to_table(stream, f"{room}/{name}", f"{room}/log-{name}", mode)
    return spark.read.schema(stream.schema).parquet(f"{room}/{name}")


_BARS = """select instrument, bar_end, open, high, low, close, cast(volume as bigint) as volume, round(turnover, 6) as turnover from bars_1h"""


@query(sql("bars_1h", _BARS))
def stream_bars_1h(spark, sf_dir):
    """I1, I3 final bars of a stream with repeated trades, and with rows that come days too late and are
    dropped: the watermark is two days behind."""
    late = F.col("ts") < F.lit("2024-01-04").cast("timestamp_ntz")
    s, room = _stream(spark, sf_dir, F.col("event_id") % 10 == 0, late, True)
    out = _written(spark, sb.stream_bars(s, "1 hour", "2 days", ids=("trade_id",)), room)
    return rounded(out.where("instrument <> '~'"))


@query(sql("bars_1h", _BARS))
def stream_partial_bars(spark, sf_dir):
    """I2 bars that change as their trades come in: of each bar the last of its versions."""
    s, room = _stream(spark, sf_dir)
    return rounded(sb.last_versions(sb.stream_bars(s, "1 hour", "2 days"), ["instrument", "bar_end"], f"{room}/out", f"{room}/log"))


@query(sql("ticks", "select trade_id, instrument, ts, price from ticks"))
def stream_distinct_ticks(spark, sf_dir):
    """I3 each trade of a stream once."""
    s, room = _stream(spark, sf_dir, F.col("event_id") % 3 == 0)
    out = _written(spark, sb.deduplicated(s, "2 days").select("trade_id", "instrument", "ts", "price"), room)
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_SIX = """, m as (select instrument, time_bucket(interval '1 hour', ts) as bucket, avg(price) as price_mean, arg_max(price, ts) as price_last from ticks group by all), n as (select *, row_number() over (partition by instrument order by bucket) as rn from m),
    e(instrument, rn, bucket, price_mean, price_last, smooth) as (select instrument, rn, bucket, price_mean, price_last, price_mean from n where rn = 1 union all select n.instrument, n.rn, n.bucket, n.price_mean, n.price_last, e.smooth + 2.0::double / 7 * (n.price_mean - e.smooth) from e join n on n.instrument = e.instrument and n.rn = e.rn + 1)
    select instrument, bucket, round(price_mean, 6) as price_mean, price_last, round(smooth, 6) as smooth from e"""


@query(sql("ticks", _SIX, recursive=True))
def stream_book_means(spark, sf_dir):
    """I4 left-labelled means of a stream of quotes, then smoothed by a stateful average of span 6."""
    s, room = _stream(spark, sf_dir, flush=True)
    means = _written(spark, sb.stream_means(s, "1 hour", "2 days"), room)
    smooth = sb.stream_smoothed(_rocks(spark).readStream.schema(means.schema).parquet(f"{room}/out").where("instrument <> '~'"), 6)
    return rounded(_written(spark, smooth, room, name="smooth"))


def _rocks(spark):
    """A session of its own whose streams keep their state in RocksDB; the caller's session stays as it is."""
    own = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        if spark.conf.get(name, None) is not None:
            own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


@query(sql("bars_1h", f""", {ema_sql(5, 12)}, t as (select *, case when rn >= 12 then cast(sign(ema_fast - ema_slow) as integer) else 0 end as target, lag(close) over w as prior from ema window w as (partition by instrument order by rn)),
    p as (select *, coalesce(lag(target) over w, 0) as position from t window w as (partition by instrument order by rn)),
    g as (select *, coalesce(lag(position) over w, 0) * coalesce(close - prior, 0) - abs(position - coalesce(lag(position) over w, 0)) * 0.05::double as pnl from p window w as (partition by instrument order by rn))
    select instrument, bar_end, close, round(ema_fast, 6) as ema_fast, round(ema_slow, 6) as ema_slow, position, round(pnl, 5) as pnl, round(sum(pnl) over (partition by instrument order by rn rows unbounded preceding), 4) as cum_pnl from g""", recursive=True))
def stream_ema_positions(spark, sf_dir):
    """I6, I7, F21 stateful positions per instrument; bars that come again are ignored."""
    room = _room(spark)
    b = views.event_bars(spark, sf_dir).select("instrument", "bar_end", "close")
    _in_order(b, "bar_end", f"{room}/in")
    again = b.where(F.col("bar_end") < F.lit("2024-01-10").cast("timestamp_ntz")).withColumn("close", F.col("close") + 1)
    again.write.mode("append").parquet(f"{room}/in")  # already processed, so they change nothing
    s = _rocks(spark).readStream.schema(b.schema).option("maxFilesPerTrigger", SPAN_FILES).parquet(f"{room}/in")
    out = _written(spark, sb.stream_positions(s), room)
    digits = {"ema_fast": 6, "ema_slow": 6, "pnl": 5, "cum_pnl": 4}
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()})


_QUARTERS = """, m as (select instrument, time_bucket(interval '5 minutes', ts - interval '1 microsecond') as part_start, price, ts from ticks), p as (select instrument, part_start, arg_min(price, ts) as open, max(price) as high, min(price) as low, arg_max(price, ts) as close from m group by all),
    q as (select instrument, time_bucket(interval '15 minutes', part_start) as bucket, arg_min(open, part_start) as open, max(high) as high, min(low) as low, arg_max(close, part_start) as close, cast(count(*) as integer) as parts from p group by all)"""


def _quarters(spark, sf_dir):
    """Five-minute bars as a stream that repeats some of them; a last one far ahead ends all quarter hours."""
    from barwright.operators import bars

    room = _room(spark)
    # kept, as each span of the stream reads it
    five = kept(bars.ticks_to_bars(views.ticks(spark, sf_dir), "5 minutes").select("instrument", "bar_end", "open", "high", "low", "close"))
    _in_order(five, "bar_end", f"{room}/in")
    again = five.where(F.minute("bar_end") % 10 == 0)
    ahead = five.agg((F.max("bar_end") + F.expr("interval 90 days")).alias("bar_end"))
    again.unionByName(ahead.select(F.lit("~").alias("instrument"), "bar_end", *(F.lit(1.0).alias(c) for c in ("open", "high", "low", "close")))).write.mode("append").parquet(f"{room}/in")
    s = _rocks(spark).readStream.schema(five.schema).option("maxFilesPerTrigger", SPAN_FILES).parquet(f"{room}/in")
    return _written(spark, sm.complete_bars(s, "5 minutes", 3, "1 day"), room).where("instrument <> '~'")


@query(sql("ticks", f"{_QUARTERS} select instrument, bucket, open, high, low, close from q where parts = 3 and low > 0"))
def stream_complete_15m(spark, sf_dir):
    """I8 quarter hours of a stream of five-minute bars, each given as its third part comes."""
    return _quarters(spark, sf_dir).where("reason is null").select("instrument", "bucket", "open", "high", "low", "close")


@query(sql("ticks", f"{_QUARTERS} select instrument, bucket, parts, case when parts < 3 then 'missing_part' else 'invalid_range' end as reason from q where parts < 3 or low <= 0"))
def stream_broken_15m(spark, sf_dir):
    """I8 the quarter hours that could not be completed, and why."""
    return _quarters(spark, sf_dir).where("reason is not null").select("instrument", "bucket", "parts", "reason")


@query(sql("ticks", """, l as (select trade_id, ts, user_id % 7 as k, price from ticks where instrument = 'click'), r as (select ts, user_id % 7 as k, price from ticks where instrument = 'view')
    select l.trade_id, l.ts, l.k, l.price, r.price as view_price from l asof left join r on l.k = r.k and l.ts >= r.ts"""))
def stream_enriched(spark, sf_dir):
    """I5 two live feeds: each click with the last view of its key, views coming up to a day after their time."""
    room, own = _room(spark), _rocks(spark)
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.col("user_id") % 7)
    clicks = raw.where("event_type = 'click'").select("k", "ts", F.col("event_id").alias("trade_id"), F.col("value").alias("price"))
    view = raw.where("event_type = 'view'").select("k", "ts", F.col("value").alias("view_price"))
    end = raw.agg((F.max("ts") + F.expr("interval 90 days")).alias("ts")).select(F.lit(-1).cast("long").alias("k"), "ts")
    _in_order(clicks, "ts", f"{room}/left")
    end.withColumns({"trade_id": F.lit(0).cast("long"), "price": F.lit(0.0)}).write.mode("append").parquet(f"{room}/left")
    # every third view is delivered a day late, by the order in which files appear
    delayed = view.withColumn("_seen", F.col("ts") + F.expr("interval 1 day") * (F.xxhash64("ts", "view_price") % 3 == 0).cast("int"))
    _in_order(delayed, "_seen", f"{room}/right")

    def feed(side, like):
        return own.readStream.schema(like.schema).option("maxFilesPerTrigger", SPAN_FILES).parquet(f"{room}/{side}")

    out = sm.asof_streams(feed("left", clicks), feed("right", delayed).drop("_seen"), ["k"], "ts", ["view_price"], "30 days")
    return _written(spark, out, room).where("k >= 0")


@query(sql("ticks", """, p as (select time_bucket(interval '1 hour', ts) as bucket, arg_max(price, ts) filter (user_id % 2 = 0) as FIZ, arg_max(price, ts) filter (user_id % 2 = 1) as YUR from ticks group by all), t as (select *, cast(bucket as date) as day, coalesce(abs(FIZ), 0) + coalesce(abs(YUR), 0) as total from p),
    g as (select day, unnest(generate_series(min(bucket), max(bucket), interval '1 hour')) as bucket from t group by day)
    select g.bucket, last_value(FIZ ignore nulls) over w as FIZ, last_value(YUR ignore nulls) over w as YUR, round(last_value(total ignore nulls) over w, 6) as total from g left join t using (day, bucket) window w as (partition by g.day order by g.bucket rows unbounded preceding)"""))
def stream_pivot(spark, sf_dir):
    """I9 long rows accumulated by day as wide buckets on the day's grid, carried forward; one row per bucket."""
    s, room = _stream(spark, sf_dir)
    long = s.withColumn("clgroup", F.when(F.col("user_id") % 2 == 0, "FIZ").otherwise("YUR"))
    sb.pivot_each_batch(long, "clgroup", ["FIZ", "YUR"], "price", "1 hour", f"{room}/out", f"{room}/log")
    return rounded(spark.read.parquet(f"{room}/out/days").drop("day"))

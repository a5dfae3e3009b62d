"""Feeds by event time: late, repeated and corrected bars, and indicators kept up to date as they arrive."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidebars.operators import tables
from tidebars.session import stage_path
from tidebars.streaming import asof, event_time, extend, live
from workload import source_queries as sq
from workload import sql as q
from workload import tables as t
from workload.registry import num, query, when, whole

r = q.r
DELAY_DAYS = 370
LIVE_HOURS = 36
LIVE_PARTS = 4


def arrivals_to_feed(spark, arrivals):
    """A folder that holds the arrivals in order, read one file at a time."""
    path = stage_path(spark, "event_feed")
    for rows in arrivals:
        rows.select(*tables.BAR_COLUMNS).coalesce(1).write.mode("append").parquet(path)
    return extend.read_feed(spark, path, 1)


def drained(spark, bars):
    """The bars of a stream after its feed was drained."""
    path = stage_path(spark, "event_bars")
    event_time.write_periods(bars, path, stage_path(spark, "event_checkpoint"), once=True, period="year").awaitTermination()
    return event_time.read_periods(spark, path).select("symbol", F.date_format("ts", "yyyy-MM-dd").alias("ts"), num("close"), "volume")


def yearly(spark, sf_dir, first, again):
    """Year by year: the year's bars, those of the year before once more, and bars of four years before, which are too late."""
    bars = sq.daily(spark, sf_dir)
    low, high = bars.agg(F.min(F.year("ts")), F.max(F.year("ts"))).first()
    for year in range(low, high + 1):
        own, before, old = (bars.filter(F.year("ts") == y) for y in (year, year - 1, year - 4))
        yield own.withColumn("close", first).unionByName(before.withColumn("close", again)).unionByName(old.withColumn("close", F.lit(1.0)))


@query("stream_first_arrivals", q.with_([q.DAILY], sq.STREAM_SELECT))
def stream_first_arrivals(spark, sf_dir):
    """The first version counts; repeats with other closes and bars behind the watermark are dropped."""
    feed = arrivals_to_feed(spark, yearly(spark, sf_dir, F.col("close"), F.col("close") * 2))
    return drained(spark, event_time.first_arrivals(feed, f"{DELAY_DAYS} days"))


@query("stream_settled", q.with_([q.DAILY], f"""{sq.STREAM_SELECT}
WHERE ts <= (SELECT max(ts) FROM dbars) - INTERVAL {DELAY_DAYS} DAY"""))
def stream_settled(spark, sf_dir):
    """The last version within the delay counts, once the watermark has passed it."""
    feed = arrivals_to_feed(spark, yearly(spark, sf_dir, F.col("close") * 2, F.col("close")))
    return drained(spark, event_time.settled(feed, f"{DELAY_DAYS} days"))


def uneven(spark, sf_dir, parts):
    """Bars in parts by time; the last day of each part is sent wrong first and right with the next part."""
    bars = t.staged(spark, sf_dir, "raw_bars", lambda: t.raw_bars(spark, sf_dir))
    first, last = bars.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    at, step = F.unix_seconds("ts"), (last + 1 - first) / parts
    for k in range(parts):
        low, high = F.lit(first + k * step), F.lit(first + (k + 1) * step)
        wrong = (at >= high - 86400) & F.lit(k + 1 < parts)
        own = bars.filter((at >= low) & (at < high)).withColumn("close", F.when(wrong, F.col("close") * 1.5).otherwise(F.col("close")))
        yield own.unionByName(bars.filter((at >= low - 86400) & (at < low)))


@query("live_indicators", q.with_([q.BARS, q.IND, q.EMA], f"""
SELECT i.symbol, {q.at('i.ts')} AS ts, i.rn, {', '.join(f"{r(('e.' if c.startswith('ema') else 'i.') + c)} AS {c}" for c in live.INDICATORS)}
FROM ind i JOIN ema e ON e.symbol = i.symbol AND e.rn = i.rn
WHERE i.ts <= (SELECT max(ts) FROM bars) - INTERVAL {LIVE_HOURS} HOUR"""))
def live_indicators(spark, sf_dir):
    """Indicators from state, batch by batch, equal those over the whole table up to the watermark."""
    live.use_state_store(spark)
    path = stage_path(spark, "live_indicators")
    rows = live.live_indicators(arrivals_to_feed(spark, uneven(spark, sf_dir, LIVE_PARTS)), f"{LIVE_HOURS} hours")
    rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", stage_path(spark, "live_checkpoint")).trigger(
        availableNow=True).start().awaitTermination()
    found = spark.read.schema(rows.schema).parquet(path)
    return found.select("symbol", when("ts"), whole("rn"), *[num(c) for c in live.INDICATORS])


@query("stream_compacted", q.with_([q.DAILY], sq.STREAM_SELECT))
def stream_compacted(spark, sf_dir):
    """Four arrivals, each gathered into the snapshots; the batches behind it are removed."""
    bars = sq.daily(spark, sf_dir)
    table = stage_path(spark, "compacted_table")
    extend.start_table(bars.filter(F.year("ts") < 1995), table)
    for k in range(4):
        feed = stage_path(spark, "compacted_feed")
        bars.filter(F.year("ts") >= 1994).filter(F.dayofmonth("ts") % 4 == k).select(*tables.BAR_COLUMNS).write.parquet(feed)
        extend.extend_stream(extend.read_feed(spark, feed), table, stage_path(spark, "compacted_checkpoint"), once=True).awaitTermination()
        extend.compact(spark, table)
        extend.clean(spark, table)
    return extend.read_table(spark, table).select("symbol", F.date_format("ts", "yyyy-MM-dd").alias("ts"), num("close"), "volume")


REACH_HOURS = 30
ASOF_DELAYS = 40


@query("stream_asof_benchmark", q.with_([q.BARS, q.BENCH, q.ASOF, f"""
reached AS (
  SELECT a.symbol, a.ts, a.close, CASE WHEN x.ts > a.ts - INTERVAL {REACH_HOURS} HOUR THEN x.close END AS bench_close
  FROM bars a ASOF LEFT JOIN bench x ON a.ts >= x.ts)"""], f"""
SELECT symbol, {q.at('ts')} AS ts, close, bench_close FROM reached
WHERE ts <= (SELECT least((SELECT max(ts) FROM bars), (SELECT max(ts) FROM bench))) - INTERVAL {ASOF_DELAYS + REACH_HOURS} HOUR"""))
def stream_asof_benchmark(spark, sf_dir):
    """Bars and benchmark as two streams of uneven parts; what the watermark is past by the reach equals the batch join."""
    bars = t.staged(spark, sf_dir, "raw_bars", lambda: t.raw_bars(spark, sf_dir))
    bench = t.benchmark(spark, sf_dir).withColumn("symbol", F.lit("ALL"))
    low, high = bars.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()

    def parts(df, n):
        part = F.least(F.greatest(F.floor((F.unix_seconds("ts") - low) * n / F.lit(high + 1 - low)), F.lit(0)), F.lit(n - 1))
        return [df.filter(part == k) for k in range(n)]

    feeds = [arrivals_to_feed(spark, parts(df.select(*tables.BAR_COLUMNS), n)).drop("seq") for df, n in ((bars, 4), (bench, 3))]
    rows = asof.align_streams(*feeds, REACH_HOURS * 3600, f"{ASOF_DELAYS} hours", f"{ASOF_DELAYS} hours")
    path = stage_path(spark, "asof_bars")
    rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", stage_path(spark, "asof_checkpoint")).trigger(
        availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(path).select("symbol", when("ts"), "close", "bench_close")

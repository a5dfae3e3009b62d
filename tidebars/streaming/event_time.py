"""Bars of a feed by event time: each bar once, with state only for the time that bars may still come.

``delay`` is how far a bar may lag behind the newest bar seen. Spark keeps the watermark, newest time less ``delay``, and drops both
later bars and the state behind it, so the state is as large as the bars of one ``delay``, however long the feed runs; nothing is read
back from the table. Two readings of "each bar once":

* ``first_arrivals``: the first valid bar of a (symbol, ts) goes on at once, repeats within ``delay`` are dropped;
* ``settled``: the last valid version sent within ``delay`` goes on, once the watermark has passed it.

Bars that lag by more than ``delay`` are left out of both, from the batch after the one that moved the watermark past them at the
latest (Spark counts them as ``numRowsDroppedByWatermark``);
``extend.extend_stream`` takes bars of any age, by reading the table. ``write_periods`` keeps the result in folders by day, or a longer
period for sparser bars, through Spark's file sink: a batch that runs again after a failure counts once.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidebars.operators.tables import BAR_COLUMNS
from tidebars.streaming.extend import BAR_SCHEMA

VALUES = BAR_COLUMNS[2:]


def valid(feed: DataFrame) -> DataFrame:
    """Complete bars with a positive close, as ``tables.clean_feed`` takes them; row by row."""
    whole = feed.dropna(subset=["symbol", "ts", "open", "high", "low", "close"]).filter(F.col("close") > 0)
    return whole.withColumn("volume", F.coalesce("volume", F.lit(0.0)))


def first_arrivals(feed: DataFrame, delay: str) -> DataFrame:
    """Each bar when it first comes. Of versions in one batch any one counts: use ``settled`` where versions differ."""
    return valid(feed).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["symbol", "ts"]).select(*BAR_COLUMNS)


def settled(feed: DataFrame, delay: str) -> DataFrame:
    """Each bar as it was last sent (by ``seq``) before the watermark passed it."""
    marked = valid(feed).withWatermark("ts", delay)
    last = marked.groupBy("symbol", "ts").agg(F.max_by(F.struct(*VALUES), "seq").alias("b"))
    return last.select("symbol", "ts", *[F.col(f"b.{c}").alias(c) for c in VALUES])


def write_periods(bars: DataFrame, path: str, checkpoint: str, once: bool = False, period: str = "day") -> StreamingQuery:
    """Append streamed bars to folders ``period=<first day>``; ``once`` stops when the feed is drained."""
    writer = (
        bars.withColumn("period", F.date_trunc(period, "ts").cast("date")).writeStream.format("parquet").partitionBy("period").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_periods(spark: SparkSession, path: str) -> DataFrame:
    """The table of ``write_periods``; a filter on ``period`` reads those folders only."""
    return spark.read.schema(f"{BAR_SCHEMA}, period date").parquet(path)

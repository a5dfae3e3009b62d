"""Bars, moves and features derived from the driver's tables.

``events`` are ticks without prices. Their values become one-minute bars of a
price walk: integer cents are summed per bar, scanned into a running level, and
turned into prices in whole cents, so that any engine derives the same bars.
``orders`` become daily bars over seven calendar years in the same way.

Derived tables are staged once per session and folder and shared by the queries.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.operators import best_moves, features, indicators, pivots, swings
from tidebars.series import Running, index_series, locate_moves, move_bars, running
from tidebars.session import stage

BAR_SECONDS = 60
STEP = 5000          # cents that leave the level unchanged
PACE = 0.02          # size of a step of the walk
WEEK_SECONDS = 7 * 86400
EPOCH_OFFSET = 4 * 86400   # weeks start on Monday

_staged: dict[tuple, DataFrame] = {}


def staged(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _staged:
        _staged[key] = stage(build(), name)
    return _staged[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utc(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def week(ts: Column) -> Column:
    """Number of the Monday-based week; the period of the moves (a year is too long here)."""
    seconds = F.unix_seconds(ts.cast("timestamp"))
    return F.floor((seconds + F.lit(3 * 86400)) / F.lit(WEEK_SECONDS)).cast("int")


def walk(sums: DataFrame, pace: float) -> DataFrame:
    """Bars from per-bar tick sums ``s``, counts ``n`` and first ticks ``f``."""
    sums = sums.withColumn("day", F.to_date("ts"))
    level = running(sums, ["symbol"], [Running("level", "sum", F.col("s") - F.lit(STEP) * F.col("n"))],
                    order="ts", tile="day")
    before = F.col("level") - (F.col("s") - F.lit(STEP) * F.col("n"))
    share = (F.pmod(F.col("f"), F.lit(7)) - 1) / F.lit(5.0)

    def price(x: Column) -> Column:
        return F.lit(100.0) * F.exp(F.lit(pace) * x / F.lit(float(STEP)))

    opened = price(before + share * (F.col("f") - F.lit(STEP)))
    closed = price(F.col("level").cast("double"))
    up = F.exp(F.lit(pace) * F.pmod(F.col("s"), F.lit(11)) / F.lit(20.0))
    down = F.exp(F.lit(-pace) * F.pmod(F.col("s"), F.lit(13)) / F.lit(24.0))
    return level.select(
        "symbol", "ts",
        F.round(opened, 2).alias("open"),
        F.round(F.greatest(opened, closed) * up, 2).alias("high"),
        F.round(F.least(opened, closed) * down, 2).alias("low"),
        F.round(closed, 2).alias("close"),
        F.col("s").cast("double").alias("volume"),
    )


def tick_sums(ticks: DataFrame, bar: Column) -> DataFrame:
    """Sums per (symbol, bar), combined before the shuffle: no symbol is gathered."""
    return ticks.groupBy("symbol", bar.alias("ts")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("cents").alias("s"),
        F.min(F.struct("at", "id", "cents")).getField("cents").alias("f"),
    )


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat_ws("_", "event_type", F.pmod("user_id", F.lit(4))).alias("symbol"),
        F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("id"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
    )


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    utc(spark)
    sums = staged(spark, sf_dir, "tick_sums", lambda: tick_sums(
        event_ticks(spark, sf_dir), F.date_trunc("minute", "at")))
    return walk(sums, PACE)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-minute bars, numbered and chunked."""
    raw = staged(spark, sf_dir, "raw_bars", lambda: raw_bars(spark, sf_dir))
    return staged(spark, sf_dir, "bars", lambda: index_series(raw, BAR_SECONDS))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly closes over all events: sparser than the bars, so that as-of matters."""
    utc(spark)
    ticks = event_ticks(spark, sf_dir).withColumn("symbol", F.lit("ALL"))
    sums = staged(spark, sf_dir, "benchmark_sums", lambda: tick_sums(ticks, F.date_trunc("hour", "at")))
    return staged(spark, sf_dir, "benchmark", lambda: walk(sums, 0.002))


def swing_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        raw = staged(spark, sf_dir, "raw_swings", lambda: swings.raw_swings(bars(spark, sf_dir)))
        return swings.collapse(raw)
    return staged(spark, sf_dir, "swings", build)


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with all indicators and swing marks."""
    def build() -> DataFrame:
        wide = indicators.all_indicators(bars(spark, sf_dir), benchmark(spark, sf_dir))
        return features.attach_swings(wide, swing_table(spark, sf_dir))
    return staged(spark, sf_dir, "frame", build)


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best move of each (symbol, week), with row numbers."""
    def build() -> DataFrame:
        b = bars(spark, sf_dir)
        return locate_moves(best_moves.best_moves(b, week(F.col("ts"))), b)
    return staged(spark, sf_dir, "moves", build)


def pivot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "pivots", lambda: pivots.pivots(moves(spark, sf_dir), frame(spark, sf_dir)))


def move_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "features", lambda: features.move_features(
        pivot_table(spark, sf_dir), frame(spark, sf_dir)))


def inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicator rows of every move."""
    return staged(spark, sf_dir, "inside", lambda: move_bars(moves(spark, sf_dir), frame(spark, sf_dir)))

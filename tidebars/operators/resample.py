"""Coarser bars from finer ones, and bars from ticks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resample(bars: DataFrame, unit: str = "week") -> DataFrame:
    """Weekly, monthly or other calendar bars; partial results are combined before the shuffle."""
    first, last = F.min(F.struct("ts", "open")), F.max(F.struct("ts", "close"))
    return (
        bars.groupBy("symbol", F.date_trunc(unit, F.col("ts").cast("timestamp")).alias("period"))
        .agg(
            first.getField("open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
            last.getField("close").alias("close"), F.sum("volume").alias("volume"),
            F.count(F.lit(1)).alias("bars"),
        )
        .withColumnRenamed("period", "ts")
    )


def tick_bars(ticks: DataFrame, bar_seconds: int, price: Column, size: Column, order: Column) -> DataFrame:
    """Bars of ``bar_seconds`` from ticks with symbol and ts; ``order`` breaks ties of ts."""
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    bar = F.timestamp_seconds(second - F.pmod(second, F.lit(bar_seconds)))
    tick = F.struct("ts", order.alias("o"), price.alias("p"))
    return ticks.groupBy("symbol", bar.alias("bar")).agg(
        F.min(tick).getField("p").alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max(tick).getField("p").alias("close"), F.sum(size).cast("double").alias("volume"),
    ).withColumnRenamed("bar", "ts")

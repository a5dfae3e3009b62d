"""Bars and a benchmark that arrive as two streams, joined as of each bar.

A bar takes the benchmark's last close at or before it, no older than ``reach``. Both sides wait in state: a bar until both
watermarks have passed it, so that a benchmark that comes late is still found, a close until no bar can ask for it any more. Both are
keyed by a slot of time as wide as the reach; a close stands in its own slot and in the next, so that equal keys meet whatever
is in reach. A bar comes out when the watermark, the earlier of the two, is ``reach`` past it.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.operators.tables import BAR_COLUMNS


def _slot(ts: str, seconds: int) -> Column:
    return F.floor(F.unix_seconds(ts) / F.lit(seconds))


def align_streams(bars: DataFrame, benchmark: DataFrame, reach_seconds: int, bar_delay: str, benchmark_delay: str) -> DataFrame:
    """``bars`` (one row per symbol and time) with ``bench_close``, null where no close is in reach; a stream in append mode."""
    left = bars.withWatermark("ts", bar_delay).withColumn("slot", _slot("ts", reach_seconds))
    known = benchmark.filter(F.col("close").isNotNull()).select(F.col("ts").alias("bench_ts"), F.col("close").alias("bench_close"))
    right = known.withWatermark("bench_ts", benchmark_delay).withColumn("at", _slot("bench_ts", reach_seconds))
    right = right.select("bench_ts", "bench_close", F.explode(F.array("at", F.col("at") + 1)).alias("bench_slot"))
    reach = F.expr(f"INTERVAL {reach_seconds} SECONDS")
    met = left.join(right, (F.col("slot") == F.col("bench_slot")) & (F.col("bench_ts") <= F.col("ts")) & (F.col("bench_ts") > F.col("ts") - reach),
                    "leftOuter")
    # of the closes in reach the last; of two at one time the larger, as the batch join has it
    rest = [c for c in BAR_COLUMNS if c not in ("symbol", "ts")]
    last = met.groupBy("symbol", "ts").agg(
        F.max(F.when(F.col("bench_ts").isNotNull(), F.struct("bench_ts", "bench_close"))).alias("b"), *(F.max(c).alias(c) for c in rest))
    return last.select(*BAR_COLUMNS, F.col("b.bench_close").alias("bench_close"))

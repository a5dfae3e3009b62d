"""Swing highs and lows.

A swing is known only ``lookback`` bars later, so swings are for studying past
moves, not for acting on the bar that carries them.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.series import CHUNK, IN_CHUNK, Running, core, rows, running, with_halo

LOOKBACK = 3


def raw_swings(indexed: DataFrame, lookback: int = LOOKBACK, chunk_rows: int = CHUNK) -> DataFrame:
    """Bars whose high is strictly above, or else whose low is strictly below, both sides."""
    left, right = rows(-lookback, -1), rows(1, lookback)
    df = with_halo(indexed, before=lookback, after=lookback, chunk_rows=chunk_rows).selectExpr(
        "*",
        f"max(high) {left} AS left_high", f"max(high) {right} AS right_high",
        f"min(low) {left} AS left_low", f"min(low) {right} AS right_low",
        f"rn > {lookback} AND lead(rn, {lookback}) OVER ({IN_CHUNK}) IS NOT NULL AS full",
    )
    kind = ("CASE WHEN full AND high > left_high AND high > right_high THEN 'high' "
            "WHEN full AND low < left_low AND low < right_low THEN 'low' END AS kind")
    return core(df).selectExpr("*", kind).filter("kind IS NOT NULL").selectExpr(
        "symbol", "chunk", "rn", "ts", "kind", "CASE kind WHEN 'high' THEN high ELSE low END AS price")


def collapse(raw: DataFrame) -> DataFrame:
    """Keep the most extreme swing of each run of one kind, the earliest on ties.

    A run is named by the last swing of the other kind before it (``after_rn``, 0 at the
    start), found with a scan over chunks, so a run may cross chunks. ``last_rn`` is the last
    raw swing of the run: the next run has it as its ``after_rn``.
    """
    seen = running(raw, ["symbol"], [
        Running("last_high", "max", F.expr("CASE kind WHEN 'high' THEN rn END"), exclusive=True),
        Running("last_low", "max", F.expr("CASE kind WHEN 'low' THEN rn END"), exclusive=True),
    ])
    runs = seen.selectExpr(
        "*", "coalesce(CASE kind WHEN 'high' THEN last_low ELSE last_high END, 0) AS after_rn",
        "CASE kind WHEN 'high' THEN price ELSE -price END AS extreme",
    )
    best = F.expr("max(named_struct('x', extreme, 'o', -rn, 'chunk', chunk, 'rn', rn, 'ts', ts, 'price', price))")
    return (
        runs.groupBy("symbol", "kind", "after_rn").agg(best.alias("s"), F.max("rn").alias("last_rn"))
        .select("symbol", "s.chunk", "s.rn", "s.ts", "kind", "s.price", "after_rn", "last_rn")
    )


def swings(indexed: DataFrame, lookback: int = LOOKBACK, chunk_rows: int = CHUNK) -> DataFrame:
    """Strictly alternating swing highs and lows of each symbol."""
    return collapse(raw_swings(indexed, lookback, chunk_rows))

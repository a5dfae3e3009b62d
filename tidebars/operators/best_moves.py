"""Discovery and repair of moves (low to high inside one period)."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.series import Running, running

MOVE_COLUMNS = ("year", "symbol", "gain_pct", "low_date", "high_date", "low_price", "high_price", "avg_vol_b")


def best_moves(indexed: DataFrame, period: Column | None = None) -> DataFrame:
    """Largest low-to-high gain on closes inside each (symbol, period).

    The low comes at or before the high; ties go to the earliest high and the earliest low of
    that price. A low at or below zero gives no gain, nor do later bars of the period, whose low it stays; null closes are
    skipped. Periods without a gain are left out. ``period`` defaults to the calendar year
    and must not decrease with time. Values are not rounded, see ``rounded_moves``.
    """
    period = F.year("ts") if period is None else period
    closes = indexed.select("symbol", "chunk", "rn", "ts", "close", "volume", period.alias("year"))
    known = F.when(F.col("close").isNotNull(), F.struct("close", "rn", "ts"))
    lows = running(closes, ["symbol", "year"], [Running("low", "min", known)])
    gain = (F.try_divide("close", "low.close") - 1) * 100.0
    gained = lows.withColumn("gain_pct", F.when(F.col("low.close") > 0, gain))
    best = F.max(F.when(
        F.col("gain_pct").isNotNull(),
        F.struct("gain_pct", (-F.col("rn")).alias("o"), "low", F.struct("close", "rn", "ts").alias("high")),
    ))
    return (
        gained.groupBy("symbol", "year")
        .agg(best.alias("b"), F.avg("volume").alias("avg_vol"))
        .filter(F.col("b.gain_pct") > 0)
        .select(
            "year", "symbol", F.col("b.gain_pct").alias("gain_pct"),
            F.col("b.low.ts").alias("low_date"), F.col("b.high.ts").alias("high_date"),
            F.col("b.low.close").alias("low_price"), F.col("b.high.close").alias("high_price"),
            (F.col("avg_vol") / 1e9).alias("avg_vol_b"),
        )
    )


def rounded_moves(moves: DataFrame) -> DataFrame:
    """Gain to 2 places, prices to 3, volume to 2, as the moves file holds them."""
    return moves.withColumns({
        "gain_pct": F.round("gain_pct", 2), "low_price": F.round("low_price", 3),
        "high_price": F.round("high_price", 3), "avg_vol_b": F.round("avg_vol_b", 2),
    })


def cross_period(moves: DataFrame, low_period: Column | None = None, high_period: Column | None = None) -> DataFrame:
    """Moves whose low or high lies outside their own period."""
    low_period = F.year("low_date") if low_period is None else low_period
    high_period = F.year("high_date") if high_period is None else high_period
    outside = ~low_period.eqNullSafe(F.col("year")) | ~high_period.eqNullSafe(F.col("year"))
    return moves.filter(F.col("year").isNotNull() & outside)


def periods_covered(moves: DataFrame, low_period: Column | None = None, high_period: Column | None = None) -> DataFrame:
    """One row per (move, covered period) as ``covered``; the move's own period is always there.

    Reversed dates are swapped; a move with a missing date covers only its own period.
    """
    low_period = F.year("low_date") if low_period is None else low_period
    high_period = F.year("high_date") if high_period is None else high_period
    first, last = F.least(low_period, high_period), F.greatest(low_period, high_period)
    both = low_period.isNotNull() & high_period.isNotNull()
    spanned = F.when(both, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    own = F.array(F.col("year").cast("int"))
    return moves.withColumn("covered", F.explode(F.array_union(spanned.cast("array<int>"), own)))


def repair_plan(moves: DataFrame, indexed: DataFrame, period: Column | None = None,
                low_period: Column | None = None, high_period: Column | None = None,
                search: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """What to do for each period that a cross-period move touches.

    ``search`` gives the best moves of asked (symbol, year), by default from the bars of those periods; with chunk summaries
    ``range_moves.best_of_periods`` reads the ends of the periods only.

    ``action`` is REWRITE (own period), ADD (missing period) or SKIP with a ``reason``:
    exists, no_bars or no_move. The new values are in the ``new_*`` columns.
    """
    touched = periods_covered(cross_period(moves, low_period, high_period), low_period, high_period)
    asked = touched.select("symbol", F.col("covered").alias("year")).distinct()
    if search is None:     # only the bars of touched symbols and periods
        own_period = F.year("ts") if period is None else period
        near = indexed.withColumn("year", own_period.cast("int")).join(asked, ["symbol", "year"], "left_semi").drop("year")
        best = best_moves(near, period)
    else:
        best = search(asked)
    found = rounded_moves(best).select(
        "symbol", F.col("year").cast("int").alias("covered"),
        *[F.col(c).alias(f"new_{c}") for c in MOVE_COLUMNS if c not in ("year", "symbol")],
    )
    with_bars = indexed.select("symbol").distinct().withColumn("has_bars", F.lit(True))
    existing = moves.select("symbol", F.col("year").cast("int").alias("covered")).distinct().withColumn(
        "exists", F.lit(True))
    joined = (
        touched.join(found, ["symbol", "covered"], "left")
        .join(with_bars, "symbol", "left")
        .join(existing, ["symbol", "covered"], "left")
    )
    own = F.col("covered") == F.col("year")
    reason = (
        F.when(F.col("has_bars").isNull(), "no_bars")
        .when(F.col("new_gain_pct").isNull(), "no_move")
        .when(~own & F.col("exists").isNotNull(), "exists")
    )
    planned = joined.withColumn("reason", reason).withColumn(
        "action", F.when(reason.isNotNull(), "SKIP").when(own, "REWRITE").otherwise("ADD")
    ).drop("has_bars", "exists")
    # two moves of one symbol may ask for the same missing period: the earlier row adds it
    adds = planned.filter(F.col("action") == "ADD")
    first = adds.groupBy("symbol", "covered").agg(F.min("year").alias("first_year"))
    marked = planned.join(first, ["symbol", "covered"], "left")
    late = (F.col("action") == "ADD") & (F.col("year") != F.col("first_year"))
    return marked.withColumns({
        "reason": F.when(late, "exists").otherwise(F.col("reason")),
        "action": F.when(late, "SKIP").otherwise(F.col("action")),
    }).drop("first_year")


def apply_repair(moves: DataFrame, plan: DataFrame) -> DataFrame:
    """Moves with the rewrites in place and the additions appended, ordered by (year, symbol).

    Columns the repair does not compute are copied from the row that caused it.
    """
    made = plan.filter(F.col("action").isin("REWRITE", "ADD"))
    new_values = {c for c in MOVE_COLUMNS if c not in ("year", "symbol")}
    columns = [
        F.col("covered").cast(f.dataType).alias("year") if f.name == "year"
        else F.col(f"new_{f.name}").cast(f.dataType).alias(f.name) if f.name in new_values
        else F.col(f.name)
        for f in moves.schema.fields
    ]
    fresh = made.select(*columns)
    kept = moves.join(fresh.select("symbol", "year"), ["symbol", "year"], "left_anti").select(*moves.columns)
    return kept.unionByName(fresh).orderBy("year", "symbol")


def repair_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action", "reason").agg(F.count(F.lit(1)).alias("n"))

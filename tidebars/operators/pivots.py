"""Breakout pivots: the best (day, base) pair inside each move.

A pivot needs the end of the move, so it describes the past only.
"""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.series import CHUNK, MOVE_KEY, back, bars_at, chunk_of, core, rows, with_halo


class PivotRules(NamedTuple):
    min_base: int = 15
    max_base: int = 80
    stride: int = 3
    max_depth: float = 0.25
    min_rel_vol: float = 1.4


def quality(max_depth: float) -> str:
    """Longer, tighter bases and larger volume score higher; 0 to 1."""
    long_part = "least(base_len, 50) / 50D"
    tight_part = f"greatest(0D, 1D - depth / {max_depth!r}D)"
    volume_part = "least(rel_vol / 3D, 1D)"
    return f"0.45D * ({long_part}) + 0.40D * {tight_part} + 0.15D * {volume_part}"


def base_extremes(frame: DataFrame, rules: PivotRules = PivotRules(), chunk_rows: int = CHUNK) -> DataFrame:
    """Per bar, highs and lows that build every base length without rescanning it.

    The shortest base is one frame; each longer base adds ``stride`` bars, whose extremes are
    lags of one short frame. ``more_highs[k]`` are the bars that step k+1 adds.
    """
    steps = (rules.max_base - rules.min_base) // rules.stride
    df = with_halo(
        frame.select("symbol", "chunk", "rn", "high", "low", "close", "rel_vol"),
        before=rules.max_base + 1, chunk_rows=chunk_rows,
    )
    first, step = rows(-rules.min_base, -1), rows(-(rules.stride - 1))
    df = df.selectExpr(
        "*", f"max(high) {first} AS first_high", f"min(low) {first} AS first_low",
        f"max(high) {step} AS step_high", f"min(low) {step} AS step_low",
    )
    offsets = [rules.min_base + k * rules.stride + 1 for k in range(steps)]
    for c in ("high", "low"):    # one pass each: fewer columns in flight
        df = df.selectExpr("*", f"array({', '.join(back(f'step_{c}', n) for n in offsets)}) AS more_{c}s")
    return core(df).filter(F.col("rel_vol") >= rules.min_rel_vol).filter("close IS NOT NULL").select(
        "symbol", "chunk", "rn", "close", "rel_vol", "first_high", "first_low", "more_highs", "more_lows")


def candidates(located: DataFrame, frame: DataFrame, rules: PivotRules = PivotRules(),
               chunk_rows: int = CHUNK) -> DataFrame:
    """Every qualifying (day, base) pair with its quality.

    Days are filtered on volume before any base length is produced.
    """
    days = base_extremes(frame, rules, chunk_rows)
    windows = (
        located.filter(F.col("n_bars") >= rules.min_base + 2)
        .filter(F.col("low_date") < F.col("high_date"))
        .select(*MOVE_KEY, "rn_lo", "rn_hi")
        .withColumn("first_day", F.col("rn_lo") + rules.min_base)
        .withColumn("last_day", F.col("rn_hi") - 1)
        .withColumn("chunk", F.explode(F.sequence(
            chunk_of("first_day", chunk_rows), chunk_of("last_day", chunk_rows))))
    )
    in_move = windows.join(days, ["symbol", "chunk"]).filter("rn BETWEEN first_day AND last_day")
    steps = (rules.max_base - rules.min_base) // rules.stride
    fitting = f"least({steps}, floor((rn - rn_lo - {rules.min_base}) / {rules.stride}))"
    key = list(MOVE_KEY)
    paired = in_move.selectExpr("*", "CAST(rn - rn_lo AS INT) AS pos",
                                f"explode(sequence(0, CAST({fitting} AS INT))) AS k")
    with_base = paired.selectExpr(
        *key, "rn", "pos", "close", "rel_vol", f"{rules.min_base} + k * {rules.stride} AS base_len",
        "greatest(first_high, array_max(slice(more_highs, 1, k))) AS base_high",
        "least(first_low, array_min(slice(more_lows, 1, k))) AS base_low",
    )
    kept = with_base.selectExpr("*", "CASE WHEN base_high > 0 THEN (base_high - base_low) / base_high END AS depth").filter(
        (F.col("depth") <= rules.max_depth) & (F.col("close") > F.col("base_high"))
    )
    return kept.selectExpr("*", f"{quality(rules.max_depth)} AS quality_score")


def best_candidates(pairs: DataFrame) -> DataFrame:
    """Best pair per move: highest quality, then earliest day, then shortest base."""
    best = F.max(F.struct(
        "quality_score", (-F.col("pos")).alias("o1"), (-F.col("base_len")).alias("o2"),
        "rn", "pos", "base_len", "base_high", "base_low", "depth", "rel_vol", "close",
    ))
    return (
        pairs.groupBy(*MOVE_KEY).agg(best.alias("b"))
        .select(
            *MOVE_KEY, F.col("b.rn").alias("rn_pivot"), F.col("b.pos").alias("pivot_idx_in_window"),
            F.col("b.base_len").alias("base_len"),
            (F.col("b.rn") - F.col("b.base_len")).alias("rn_base_start"),
            (F.col("b.rn") - 1).alias("rn_base_end"),
            F.col("b.base_high").alias("base_high"), F.col("b.base_low").alias("base_low"),
            (F.col("b.depth") * 100.0).alias("base_depth_pct"),
            F.col("b.rel_vol").alias("breakout_rel_vol"), F.col("b.close").alias("breakout_close"),
            F.col("b.quality_score").alias("quality_score"),
        )
    )


def pivots(located: DataFrame, frame: DataFrame, rules: PivotRules = PivotRules(),
           chunk_rows: int = CHUNK) -> DataFrame:
    """One row per move that has a pivot, with the dates of the pivot and of its base."""
    best = best_candidates(candidates(located, frame, rules, chunk_rows))
    dated = bars_at(
        best, frame, {"pivot": "rn_pivot", "start": "rn_base_start", "end": "rn_base_end"}, ["ts"],
        chunk_rows=chunk_rows,
    )
    renames = {"pivot_ts": "pivot_date", "start_ts": "base_start", "end_ts": "base_end"}
    return dated.withColumnsRenamed(renames)


def pivot_lookup(moves: DataFrame, pivot_table: DataFrame, symbol: str, year: int) -> DataFrame:
    """The move's row with its pivot, null when it has none; empty when there is no such move."""
    move = moves.filter((F.upper("symbol") == symbol.strip().upper()) & (F.col("year") == year)).select(*MOVE_KEY)
    return move.join(pivot_table, list(MOVE_KEY), "left")

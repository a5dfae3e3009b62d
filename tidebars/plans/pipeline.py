"""The end-to-end jobs: classify moves, report on moves, repair the moves table."""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame

from tidebars.operators import analytics, best_moves, features, indicators, pivots, resolve, swings, tables
from tidebars.operators.setups import DETECTORS, detect_all
from tidebars.series import CHUNK, index_series, locate_moves, move_bars
from tidebars.session import stage


class Prepared(NamedTuple):
    """Numbered bars, their swings, and both with indicators."""

    bars: DataFrame
    swings: DataFrame
    frame: DataFrame


def prepare(bars: DataFrame, benchmark: DataFrame | None = None, bar_seconds: float | None = None,
            chunk_rows: int = CHUNK) -> Prepared:
    """Everything about bars that does not depend on moves; each table is staged once.

    The source is staged first: numbering reads it twice, and text would be parsed twice. Bars without a close are left out.
    """
    indexed = stage(index_series(stage(bars.filter("close is not null"), "source_bars"), bar_seconds, chunk_rows), "bars")
    raw = stage(swings.raw_swings(indexed, chunk_rows=chunk_rows), "raw_swings")
    collapsed = stage(swings.collapse(raw), "swings")
    wide = indicators.all_indicators(indexed, benchmark, chunk_rows)
    return Prepared(indexed, collapsed, stage(features.attach_swings(wide, collapsed), "frame"))


def classify_moves(moves: DataFrame, prepared: Prepared, prior: DataFrame | None = None,
                   rules: pivots.PivotRules = pivots.PivotRules(), detectors: dict | None = None,
                   chunk_rows: int = CHUNK) -> DataFrame:
    """One record per move; ``prior`` records keep their human fields and unseen keys."""
    table = DETECTORS if detectors is None else detectors
    located = stage(locate_moves(moves, prepared.bars, chunk_rows=chunk_rows), "moves")
    pivot_table = stage(pivots.pivots(located, prepared.frame, rules, chunk_rows), "pivots")
    measured = features.move_features(pivot_table, prepared.frame, chunk_rows)
    resolved = resolve.resolve(detect_all(measured, table), tuple(table))
    fresh = resolve.classify(moves, prepared.bars, pivot_table, resolved)
    return tables.merge_classifications(fresh, prior)


class Report(NamedTuple):
    """What is known about the quality of each move."""

    stats: DataFrame
    quarters: DataFrame
    gaps: DataFrame
    streaks: DataFrame
    slopes: DataFrame
    screen: DataFrame


def report_moves(moves: DataFrame, prepared: Prepared, chunk_rows: int = CHUNK) -> Report:
    """Statistics, quarters, gaps, streaks, slopes and screen of all given moves."""
    located = locate_moves(moves, prepared.bars, chunk_rows=chunk_rows)
    inside = stage(move_bars(located, prepared.frame, chunk_rows), "inside")
    stats, gaps = analytics.window_stats(inside), analytics.gap_scan(inside)
    streaks = analytics.longest_streak(inside)
    return Report(
        stats, analytics.quarter_stats(inside), gaps, streaks, analytics.trend_slope(inside),
        analytics.quick_screen(stats, gaps, streaks),
    )


def repair_moves(moves: DataFrame, bars: DataFrame, period: Column | None = None,
                 low_period: Column | None = None, high_period: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The repair plan (the dry run) and the repaired moves."""
    plan = stage(best_moves.repair_plan(moves, bars, period, low_period, high_period), "repair_plan")
    return plan, best_moves.apply_repair(moves, plan)

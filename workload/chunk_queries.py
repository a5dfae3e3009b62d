"""Twins of queries over bars cut into chunks so short that every symbol has several; their checking SQL is the same."""
from __future__ import annotations

from tidebars.operators import analytics as a
from tidebars.operators import best_moves as bm
from tidebars.operators import features, indicators, pivots, supertrend, swings
from tidebars.series import index_series, locate_moves, move_bars
from workload import analytics_queries as aq
from workload import indicator_queries as iq
from workload import tables as t
from workload.registry import CHECKS, num, query, when, whole

CUT = 128


def twin(name: str):
    return query(f"{name}_short_chunks", CHECKS[name])


def bars(spark, sf_dir):
    raw = t.staged(spark, sf_dir, "raw_bars", lambda: t.raw_bars(spark, sf_dir))
    return t.staged(spark, sf_dir, "cut_bars", lambda: index_series(raw, chunk_rows=CUT))


def swing_table(spark, sf_dir):
    raw = t.staged(spark, sf_dir, "cut_raw_swings", lambda: swings.raw_swings(bars(spark, sf_dir), chunk_rows=CUT))
    return t.staged(spark, sf_dir, "cut_swings", lambda: swings.collapse(raw))


def frame(spark, sf_dir):
    def build():
        wide = indicators.all_indicators(bars(spark, sf_dir), t.benchmark(spark, sf_dir), CUT)
        return features.attach_swings(wide, swing_table(spark, sf_dir))
    return t.staged(spark, sf_dir, "cut_frame", build)


def moves(spark, sf_dir):
    def build():
        b = bars(spark, sf_dir)
        return locate_moves(bm.best_moves(b, t.week(b["ts"])), b, chunk_rows=CUT)
    return t.staged(spark, sf_dir, "cut_moves", build)


def inside(spark, sf_dir):
    return t.staged(spark, sf_dir, "cut_inside", lambda: move_bars(moves(spark, sf_dir), frame(spark, sf_dir), CUT))


@twin("all_indicators")
def all_indicators(spark, sf_dir):
    return frame(spark, sf_dir).select(*iq.averages(iq.ALL_COLUMNS))


@twin("custom_averages")
def custom_averages(spark, sf_dir):
    df = indicators.moving_averages(bars(spark, sf_dir), sma=(45,), ema=iq.SPANS, chunk_rows=CUT)
    return df.select(*iq.averages(["sma45", *[f"ema{n}" for n in iq.SPANS]]))


@twin("swings")
def swing_points(spark, sf_dir):
    return swing_table(spark, sf_dir).select("symbol", when("ts"), whole("rn"), "kind", "price", whole("after_rn"), whole("last_rn"))


@twin("best_moves")
def best_moves(spark, sf_dir):
    return iq.shown_moves(moves(spark, sf_dir))


@twin("pivots")
def pivot_records(spark, sf_dir):
    return iq.shown_pivots(pivots.pivots(moves(spark, sf_dir), frame(spark, sf_dir), chunk_rows=CUT))


@twin("window_stats")
def window_stats(spark, sf_dir):
    return aq.shown_stats(a.window_stats(inside(spark, sf_dir)), "symbol", "year")


@twin("trend_bands")
def trend_bands(spark, sf_dir):
    return iq.shown_bands(supertrend.trend_bands(frame(spark, sf_dir), iq.BAND_FACTORS))


@twin("adaptive_bands")
def adaptive_bands(spark, sf_dir):
    return iq.shown_adaptive(supertrend.adaptive_bands(frame(spark, sf_dir), chunk_rows=CUT))

"""Setups that are read off single days: the pivot bar or a gap."""
from __future__ import annotations

# Names of setups and labels of criteria are fixed values: they appear in the results.

from pyspark.sql import Column

from tidebars.operators.setups.rules import Criterion, bonus, failure, required, result


def pocket_pivot() -> Column:
    """An up bar whose volume beats every down bar of the last ten, close to an average."""
    history = "rn_pivot >= 22"
    above = f"{history} AND coalesce(p_close > p_sma200, false)"
    down = "coalesce(p_max_down_vol, 0D)"
    beats, placed = f"p_volume > {down} AND p_volume > 0", "p_close_pos >= 0.33"
    near = (
        "(coalesce(CASE WHEN p_ema10 > 0 THEN abs(p_low - p_ema10) / p_ema10 <= 0.02 END, false) "
        "OR coalesce(CASE WHEN p_sma50 > 0 THEN abs(p_low - p_sma50) / p_sma50 <= 0.03 END, false))"
    )
    criteria = [
        Criterion("history_too_short", failure(f"NOT ({history})"), 0, "rn_pivot"),
        Criterion("above_sma200", required("p_close > p_sma200", when=history), 30, "p_sma200"),
        Criterion("up_day", required("p_close > p_prev_close", when=above), 10, "p_prev_close"),
        Criterion("vol_beats_10d_downvol", required(beats, when=above), 10, down),
        Criterion("close_upper_two_thirds", required(placed, when=above), 10, "p_close_pos"),
        Criterion("near_ma", required(near, when=above), 10, "p_low"),
        Criterion("rising_sma50", required("p_sma50 > p_sma50_back", when=above), 5, "p_sma50"),
        Criterion("aplus_close_top_quarter", bonus("p_close_pos >= 0.75", when=above), 5, "p_close_pos"),
    ]
    extra = {
        "today_vol": "coalesce(p_volume, 0D)", "max_down_vol_10d": down, "num_down_days_10d": "p_n_down_days",
    }
    return result("Pocket Pivot", criteria, f"{above} AND {beats} AND {placed} AND {near}", extra)


def episodic_pivot() -> Column:
    """A large gap on volume near the pivot whose lows hold afterwards."""
    found = "ep IS NOT NULL"
    moderate = "ep.post_range > 0.10 AND ep.post_range <= 0.15"
    criteria = [
        Criterion("qualifying_gap", required(found), 30, "ep.gap_pct"),
        Criterion("gap_gte_10pct", required("ep.gap_pct >= 0.10", when=found), 10, "ep.gap_pct"),
        Criterion("rel_vol_gte_3x", required("ep.rel_vol >= 3.0", when=found), 10, "ep.rel_vol"),
        Criterion("post_gap_held_above_gap_low", required("ep.held", when=found), 10),
        Criterion(
            "tight_consolidation", required("ep.post_range <= 0.10", when=f"{found} AND NOT ({moderate})"),
            10, "ep.post_range"),
        Criterion("moderate_consolidation", bonus(moderate, when=found), 5, "ep.post_range"),
        Criterion("aplus_gap_gte_15pct", bonus("ep.gap_pct >= 0.15", when=found), 5, "ep.gap_pct"),
        Criterion("aplus_vol_gte_5x", bonus("ep.rel_vol >= 5.0", when=found), 5, "ep.rel_vol"),
        Criterion("aplus_gap_fill_lt_30pct", required("ep.gap_fill < 0.30", when=found), 5, "ep.gap_fill"),
        Criterion("aplus_close_top_25pct", bonus("ep.close_pos >= 0.75", when=found), 5, "ep.close_pos"),
    ]
    extra = {
        "gap_date": "ep.ts", "gap_pct": "ep.gap_pct * 100", "gap_rel_vol": "ep.rel_vol",
        "post_gap_range_pct": "ep.post_range * 100", "days_to_entry": "ep.post_bars",
    }
    return result("Episodic Pivot", criteria, f"{found} AND ep.held", extra)


def gap_and_go() -> Column:
    """A larger gap that closes above its open and never fills."""
    found = "go IS NOT NULL"
    partial = f"{found} AND NOT go.gate"
    criteria = [
        Criterion("qualifying_gap", failure("go IS NULL")),
        Criterion("gate_passed", bonus("go.gate", when=found), 30, "go.gap_pct"),
        Criterion("gap_gte_10pct", required("go.gap_pct >= 0.10", when=partial), 0, "go.gap_pct"),
        Criterion("vol_gte_3x", required("go.rel_vol >= 3.0", when=partial), 0, "go.rel_vol"),
        Criterion("close_above_open", required("go.above_open", when=partial)),
        Criterion("low_above_prior_close", required("go.unfilled", when=partial)),
        Criterion("gap_gte_20pct", required("go.gap_pct >= 0.20", when=found), 10, "go.gap_pct"),
        Criterion("vol_gte_5x", required("go.rel_vol >= 5.0", when=found), 10, "go.rel_vol"),
        Criterion("close_top_50pct", required("go.close_pos >= 0.50", when=found), 10, "go.close_pos"),
        Criterion("aplus_gap_gte_30pct", bonus("go.gap_pct >= 0.30", when=found), 5, "go.gap_pct"),
        Criterion("aplus_vol_gte_8x", bonus("go.rel_vol >= 8.0", when=found), 5, "go.rel_vol"),
    ]
    extra = {"gap_date": "go.ts", "gap_pct": "go.gap_pct * 100", "gap_rel_vol": "go.rel_vol"}
    return result("Gap & Go", criteria, f"{found} AND go.gate", extra, min_score=50)

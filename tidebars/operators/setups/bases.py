"""Setups that are read off the shape of the base."""
from __future__ import annotations

# Names of setups and labels of criteria are fixed values: they appear in the results.

from pyspark.sql import Column

from tidebars.operators.setups.rules import Criterion, bonus, failure, required, result


def vcp() -> Column:
    """Shrinking contractions inside the base, then a breakout on volume."""
    several, tight = "n_contractions >= 2", "last_contraction < 0.10"
    dry = "base_len >= 10 AND base_volume > 0 AND last10_volume < base_volume * 0.75"
    criteria = [
        Criterion("prior_uptrend_20", required("prior_gain >= 0.20"), 30, "prior_gain"),
        Criterion("duration_ok", required("base_len BETWEEN 10 AND 65"), 10, "base_len"),
        Criterion("has_contractions", required(several), 10, "n_contractions"),
        Criterion("contractions_decreasing", required(f"{several} AND n_rises <= 1"), 10, "n_rises"),
        Criterion("final_contraction_tight", required(tight), 10, "last_contraction"),
        Criterion("aplus_final_5pct", bonus("last_contraction < 0.05"), 5, "last_contraction"),
        Criterion("vdu_right_side", required(dry), 5, "last10_volume"),
        Criterion("breakout_vol_surge", required("rel_vol >= 1.5"), 10, "rel_vol"),
        Criterion("aplus_breakout_2x", bonus("rel_vol >= 2.0"), 5, "rel_vol"),
        Criterion("breakout_close_upper_half", required("p_close_pos >= 0.5"), 5, "p_close_pos"),
        Criterion("near_52w_high", required("off_high <= 0.05", when="rn_pivot >= 60"), 5, "off_high"),
    ]
    extra = {
        "contractions": "contractions", "base_len": "base_len",
        "prior_gain_pct": "coalesce(prior_gain, 0D) * 100",
    }
    return result("VCP", criteria, f"{several} AND {tight}", extra)


def flat_base() -> Column:
    """A shallow sideways base of five weeks or more."""
    shallow, level = "base_depth_pct <= 15.0", "slope_ratio < 0.002"
    criteria = [
        Criterion("prior_advance_30", required("prior_gain >= 0.30"), 30, "prior_gain"),
        Criterion("duration_5w", required("base_len >= 25"), 15, "base_len"),
        Criterion("depth_under_15", required(shallow), 15, "base_depth_pct"),
        Criterion("horizontal_slope", required(level), 15, "slope_ratio"),
        Criterion("breakout_vol_14x", required("rel_vol >= 1.4"), 15, "rel_vol"),
        Criterion("aplus_depth_10", bonus("base_depth_pct <= 10.0"), 5, "base_depth_pct"),
        Criterion("aplus_sma50_rising", bonus("end_sma50 > start_sma50"), 5, "end_sma50"),
    ]
    extra = {
        "base_len": "base_len", "depth_pct": "base_depth_pct", "prior_gain_pct": "coalesce(prior_gain, 0D) * 100",
    }
    return result("Flat Base", criteria, f"{shallow} AND {level}", extra)


def cup_with_handle() -> Column:
    """The base is the handle; the cup reaches back to the last high at the handle's level."""
    history = "rn_base_start - 1 >= 35"
    found = f"{history} AND rn_edge IS NOT NULL"
    shallow, upper = "handle_depth <= 0.15", "base_low >= (cup_high + cup_low) / 2.0"
    criteria = [
        Criterion("cup_history_too_short", failure(f"NOT ({history})"), 0, "rn_base_start - 1"),
        Criterion("found_cup_left_edge", required("rn_edge IS NOT NULL", when=history), 10),
        Criterion(
            "prior_uptrend_30", required("edge_prior_gain >= 0.30", when=f"{found} AND edge_prior_gain IS NOT NULL"),
            30, "edge_prior_gain"),
        Criterion("cup_duration_7w", required("cup_days >= 35", when=found), 10, "cup_days"),
        Criterion("cup_depth_33", required("cup_depth <= 0.33", when=found), 10, "cup_depth"),
        Criterion("u_shape", required("cup_bottom_bars >= 15", when=f"{found} AND cup_low > 0"), 5, "cup_bottom_bars"),
        Criterion("handle_depth_15", required(shallow, when=found), 10, "handle_depth"),
        Criterion("handle_upper_half", required(upper, when=found), 10, "base_low"),
        Criterion("breakout_vol_15x", required("rel_vol >= 1.5", when=found), 10, "rel_vol"),
        Criterion("aplus_handle_above_50sma", bonus("base_low >= start_sma50", when=found), 5, "start_sma50"),
    ]
    extra = {
        "cup_days": "cup_days", "cup_depth_pct": "cup_depth * 100", "handle_depth_pct": "handle_depth * 100",
        "cup_left_edge": "edge_date",
    }
    return result("Cup with Handle", criteria, f"{found} AND {shallow} AND {upper}", extra)


def double_bottom() -> Column:
    """The last two swing lows before the pivot, the high between them, and a close above it."""
    enough = "rn_pivot >= 20"
    two = f"{enough} AND low2 IS NOT NULL"
    formed = f"{two} AND peak IS NOT NULL"
    level, rallied, broke = "lows_apart <= 0.05", "rally BETWEEN 0.10 AND 0.30", "p_close > peak.price"
    bars = "low2.rn - low1.rn"
    criteria = [
        Criterion("window_too_short", failure(f"NOT ({enough})"), 0, "rn_pivot"),
        Criterion("two_lows_found", required("low2 IS NOT NULL", when=enough), 10),
        Criterion("middle_peak", failure(f"{two} AND peak IS NULL")),
        Criterion("prior_context", bonus("low1_prior_gain >= 0.0", when=formed), 30, "low1_prior_gain"),
        Criterion("lows_within_5pct", required(level, when=formed), 10, "lows_apart"),
        Criterion("middle_peak_rally_10_30", required(rallied, when=formed), 10, "rally"),
        Criterion("4w_between_lows", required(f"{bars} >= 20", when=formed), 10, bars),
        Criterion("breakout_above_middle_peak", required(broke, when=formed), 10, "p_close"),
        Criterion("breakout_vol_15x", required("rel_vol >= 1.5", when=formed), 10, "rel_vol"),
        Criterion(
            "aplus_undercut", bonus("low2.price < low1.price AND low2.price > low1.price * 0.95", when=formed),
            5, "low2.price"),
    ]
    extra = {
        "low1_date": "low1.ts", "low1_price": "low1.price", "low2_date": "low2.ts", "low2_price": "low2.price",
        "peak_date": "peak.ts", "peak_price": "peak.price", "rally_pct": "rally * 100",
    }
    return result("Double Bottom", criteria, f"{formed} AND {level} AND {rallied} AND {broke}", extra)


def high_tight_flag() -> Column:
    """The base is a flag on a pole that doubled the price within 20 to 40 bars."""
    started = "coalesce(start_close > 0, false)"
    history = f"{started} AND rn_base_start - 1 >= 20"
    gain, length = "coalesce(pole.gain, 0D)", "-pole.o"
    pole = f"{history} AND {gain} >= 1.00"
    quiet = "pole.volume > 0 AND base_volume < pole.volume * 0.6"
    criteria = [
        Criterion("flag_start_nan", failure(f"NOT {started}")),
        Criterion(
            "insufficient_pole_history", failure(f"{started} AND rn_base_start - 1 < 20"), 0, "rn_base_start - 1"),
        Criterion("pole_100_in_4_8w", required(f"{gain} >= 1.00", when=history), 30, gain),
        Criterion("flag_depth_25", required("base_depth_pct <= 25.0", when=pole), 10, "base_depth_pct"),
        Criterion("flag_volume_contraction", required(quiet, when=pole), 10, "base_volume"),
        Criterion("breakout_vol_14x", required("rel_vol >= 1.4", when=pole), 10, "rel_vol"),
        Criterion("aplus_flag_depth_15", bonus("base_depth_pct <= 15.0", when=pole), 5, "base_depth_pct"),
        Criterion("aplus_pole_100_6w", bonus(f"{length} <= 30", when=pole), 5, length),
    ]
    extra = {
        "pole_gain_pct": f"{gain} * 100", "pole_len": length, "flag_len": "base_len", "flag_depth_pct": "base_depth_pct",
    }
    return result("HTF", criteria, f"{pole} AND base_depth_pct <= 25.0", extra)

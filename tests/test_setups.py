"""Detectors on measurements, one criterion at a time, and on planted series."""
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tests.makers import flat, frame
from tidebars.operators import resolve
from tidebars.operators.best_moves import best_moves
from tidebars.operators.setups import DETECTORS, detect, detect_all, register
from tidebars.plans.pipeline import classify_moves, prepare

DAY = dt.datetime(2020, 1, 1)
SWING = "struct<rn:bigint,price:double,ts:timestamp>"
SCHEMA = {
    "symbol": "string", "year": "int", "base_len": "int", "rel_vol": "double", "n_contractions": "int", "n_rises": "int",
    "last_contraction": "double", "contractions": "array<double>", "base_volume": "double", "last10_volume": "double",
    "prior_gain": "double", "p_close_pos": "double", "off_high": "double", "rn_pivot": "bigint", "base_depth_pct": "double",
    "slope_ratio": "double", "start_sma50": "double", "end_sma50": "double", "rn_base_start": "bigint", "rn_edge": "bigint",
    "handle_depth": "double", "base_low": "double", "cup_high": "double", "cup_low": "double", "cup_days": "bigint",
    "cup_depth": "double", "cup_bottom_bars": "bigint", "edge_prior_gain": "double", "edge_date": "timestamp",
    "low1": SWING, "low2": SWING, "peak": "struct<price:double,o:bigint,ts:timestamp>", "lows_apart": "double", "rally": "double",
    "low1_prior_gain": "double", "p_close": "double", "start_close": "double",
    "pole": "struct<gain:double,o:int,volume:double>", "p_sma200": "double", "p_volume": "double", "p_max_down_vol": "double",
    "p_n_down_days": "bigint", "p_prev_close": "double", "p_ema10": "double", "p_sma50": "double", "p_low": "double",
    "p_sma50_back": "double",
    "ep": "struct<ts:timestamp,gap_pct:double,rel_vol:double,held:boolean,post_range:double,gap_fill:double,close_pos:double,post_bars:bigint>",
    "go": "struct<gate:boolean,ts:timestamp,gap_pct:double,rel_vol:double,above_open:boolean,unfilled:boolean,close_pos:double>",
}
GOOD = {
    "symbol": "A", "year": 2020, "base_len": 30, "rel_vol": 2.5, "n_contractions": 3, "n_rises": 0, "last_contraction": 0.04,
    "contractions": [0.1, 0.06, 0.04], "base_volume": 100.0, "last10_volume": 60.0, "prior_gain": 0.5, "p_close_pos": 0.8,
    "off_high": 0.01, "rn_pivot": 300, "base_depth_pct": 9.0, "slope_ratio": 0.001, "start_sma50": 80.0, "end_sma50": 82.0,
    "rn_base_start": 270, "rn_edge": 200, "handle_depth": 0.09, "base_low": 91.0, "cup_high": 100.0, "cup_low": 75.0,
    "cup_days": 71, "cup_depth": 0.25, "cup_bottom_bars": 20, "edge_prior_gain": 0.4, "edge_date": DAY,
    "low1": {"rn": 240, "price": 80.0, "ts": DAY}, "low2": {"rn": 280, "price": 79.0, "ts": DAY},
    "peak": {"price": 92.0, "o": -260, "ts": DAY}, "lows_apart": 0.0125, "rally": 0.15, "low1_prior_gain": 0.1, "p_close": 101.0,
    "start_close": 95.0, "pole": {"gain": 1.2, "o": -30, "volume": 400.0}, "p_sma200": 70.0, "p_volume": 500.0,
    "p_max_down_vol": 300.0, "p_n_down_days": 4, "p_prev_close": 99.0, "p_ema10": 98.0, "p_sma50": 82.0, "p_low": 97.0,
    "p_sma50_back": 78.0,
    "ep": {"ts": DAY, "gap_pct": 0.16, "rel_vol": 5.5, "held": True, "post_range": 0.08, "gap_fill": 0.1, "close_pos": 0.9, "post_bars": 9},
    "go": {"gate": True, "ts": DAY, "gap_pct": 0.32, "rel_vol": 9.0, "above_open": True, "unfilled": True, "close_pos": 0.9},
}


def measured(spark, *changes):
    """One row of measurements per change of the good ones; year counts the rows."""
    data = []
    for i, change in enumerate(changes):
        row = {**GOOD, "year": i}
        for k, v in change.items():
            if isinstance(v, dict):
                row[k] = {**row[k], **v}
            else:
                row[k] = v
        data.append(tuple(row[c] for c in SCHEMA))
    return spark.createDataFrame(data, ", ".join(f"{k} {v}" for k, v in SCHEMA.items()))


def outcome(spark, setup, *changes):
    got = rows(detect(measured(spark, *changes), setup), "year")
    return [(r["result"]["score"], r["result"]["matched"], {c["name"]: c["met"] for c in r["result"]["criteria"]}) for r in got]


# setup -> (score when all is good, [(change, score, matched)])
CASES = {
    # all points together are 105; the score is capped
    "VCP": (100, [
        ({"last_contraction": 0.105}, 90, False), ({"n_contractions": 1}, 85, False), ({"n_rises": 2}, 95, True),
        ({"prior_gain": 0.19, "rel_vol": 1.4, "last_contraction": 0.09}, 55, False),
        ({"prior_gain": None}, 75, True), ({"base_len": 66}, 95, True), ({"rn_pivot": 59}, 100, True),
        ({"last10_volume": 75.0}, 100, True), ({"p_close_pos": None}, 100, True),
    ]),
    "Flat Base": (100, [
        ({"base_depth_pct": 15.1}, 80, False), ({"slope_ratio": 0.002}, 85, False), ({"base_len": 24}, 85, True),
        ({"base_depth_pct": 12.0}, 95, True), ({"prior_gain": 0.1}, 70, True), ({"end_sma50": None}, 95, True),
        ({"prior_gain": 0.1, "rel_vol": 1.39}, 55, False),
    ]),
    "Cup with Handle": (100, [
        ({"rn_base_start": 35}, 0, False), ({"rn_edge": None}, 0, False), ({"handle_depth": 0.16}, 90, False),
        ({"base_low": 87.0}, 90, False), ({"edge_prior_gain": None}, 70, True), ({"cup_days": 34}, 90, True),
        ({"cup_depth": 0.34}, 90, True), ({"cup_bottom_bars": 14}, 95, True), ({"start_sma50": 95.0}, 95, True),
    ]),
    "Double Bottom": (95, [
        ({"low2": None}, 0, False), ({"peak": None}, 10, False), ({"lows_apart": 0.051}, 85, False), ({"rally": 0.31}, 85, False),
        ({"p_close": 92.0}, 85, False), ({"low2": {"rn": 259}}, 85, True), ({"low1_prior_gain": -0.01}, 65, True),
        ({"rel_vol": 1.4}, 85, True), ({"low2": {"price": 81.0}}, 90, True), ({"rn_pivot": 19}, 0, False),
    ]),
    "HTF": (70, [
        ({"pole": None}, 0, False), ({"pole": {"gain": 0.99}}, 0, False), ({"base_depth_pct": 25.5}, 55, False),
        ({"base_volume": 240.0}, 60, True), ({"pole": {"o": -40}}, 65, True), ({"base_depth_pct": 16.0}, 65, True),
        ({"rel_vol": 1.3}, 60, True), ({"start_close": 0.0}, 0, False), ({"rn_base_start": 20}, 0, False),
    ]),
    "Pocket Pivot": (80, [
        ({"p_sma200": None}, 0, False), ({"p_sma200": 101.0}, 0, False), ({"p_max_down_vol": 500.0}, 70, False),
        ({"p_close_pos": 0.32}, 65, False), ({"p_low": 95.0}, 70, False), ({"p_low": 84.0}, 80, True),
        ({"p_prev_close": 101.0}, 70, True), ({"p_sma50_back": 83.0}, 75, True), ({"p_close_pos": 0.5}, 75, True),
        ({"rn_pivot": 21}, 0, False), ({"p_max_down_vol": None}, 80, True),
    ]),
    "Episodic Pivot": (90, [
        ({"ep": None}, 0, False), ({"ep": {"held": False}}, 80, False), ({"ep": {"gap_pct": 0.09}}, 75, True),
        ({"ep": {"post_range": 0.15}}, 85, True), ({"ep": {"post_range": 0.16}}, 80, True), ({"ep": {"rel_vol": 2.6}}, 75, True),
        ({"ep": {"gap_fill": 0.3}}, 85, True), ({"ep": {"gap_pct": 0.06, "rel_vol": 2.6, "gap_fill": 0.5}}, 55, False),
    ]),
    "Gap & Go": (70, [
        ({"go": None}, 0, False), ({"go": {"gate": False, "unfilled": False}}, 40, False), ({"go": {"gap_pct": 0.19}}, 55, True),
        ({"go": {"rel_vol": 4.0}}, 55, True), ({"go": {"close_pos": 0.49, "rel_vol": 4.9}}, 45, False),
    ]),
}


@pytest.mark.parametrize("setup", CASES)
def test_detector(spark, setup):
    best, cases = CASES[setup]
    got = outcome(spark, setup, {}, *[c for c, _, _ in cases])
    assert got[0][:2] == (best, True)
    for (change, score, matched), have in zip(cases, got[1:]):
        assert have[:2] == (score, matched), change


def test_criteria_that_are_not_recorded(spark):
    got = outcome(spark, "VCP", {"last_contraction": 0.06, "rn_pivot": 40})[0][2]
    assert "aplus_final_5pct" not in got and "near_52w_high" not in got and got["final_contraction_tight"]
    got = outcome(spark, "Gap & Go", {}, {"go": {"gate": False, "above_open": False}})
    assert "close_above_open" not in got[0][2]
    assert got[1][2]["close_above_open"] is False and "gate_passed" not in got[1][2]
    assert outcome(spark, "HTF", {"pole": None})[0][2] == {"pole_100_in_4_8w": False}


def test_broken_detector_is_a_result(spark):
    table = register("Mine", lambda: F.col("nothing_like_it"))
    assert list(table)[-1] == "Mine" and "Mine" not in DETECTORS
    got = rows(detect_all(measured(spark, {}), table), "year")[0]["results"]
    assert [r["setup"] for r in got] == list(table)
    assert got[-1]["criteria"][0]["name"] == "detector_error" and not got[-1]["matched"] and got[0]["matched"]


RESULTS = "array<struct<setup:string,matched:boolean,score:int>>"


@pytest.mark.parametrize("scores, primary", [
    ({}, None),
    ({"VCP": 90, "HTF": 60}, "HTF"),
    ({"Cup with Handle": 90, "HTF": 60}, "HTF"),
    ({"VCP": 90, "Cup with Handle": 60}, "Cup with Handle"),
    ({"VCP": 90, "Flat Base": 60}, "Flat Base"),
    ({"Gap & Go": 90, "Episodic Pivot": 60}, "Episodic Pivot"),
    ({"Pocket Pivot": 90, "Double Bottom": 60}, "Double Bottom"),
    ({"Pocket Pivot": 70, "Gap & Go": 80}, "Gap & Go"),
    ({"Pocket Pivot": 60}, "Pocket Pivot"),
    ({"Flat Base": 70, "Double Bottom": 70}, "Flat Base"),
    ({"HTF": 60, "VCP": 99, "Cup with Handle": 98, "Episodic Pivot": 97}, "Episodic Pivot"),
])
def test_primary(spark, scores, primary):
    results = [(n, n in scores, scores.get(n, 10)) for n in DETECTORS]
    df = spark.createDataFrame([("A", 1, results)], f"symbol string, year int, results {RESULTS}")
    got = resolve.resolve(df).first()
    assert got.primary == primary
    assert got.needs_review == (primary is None)


def test_review_counts_unmatched_scores(spark):
    results = [(n, n == "Gap & Go", 55 if n == "Gap & Go" else 10) for n in DETECTORS]
    high = [(n, m, 80 if n == "VCP" else s) for n, m, s in results]
    df = spark.createDataFrame([("A", 1, results), ("A", 2, high)], f"symbol string, year int, results {RESULTS}")
    assert [r["needs_review"] for r in rows(resolve.resolve(df), "year")] == [True, False]


def planted_flag():
    """Flat, a pole from 10 to 22, a quiet flag, a breakout on volume, then higher."""
    closes = [10.0] * 150 + list(np.linspace(10, 22, 26))[1:] + list(np.linspace(21.9, 20.4, 20)) + [24.0] + [24.5, 25.0, 25.5, 26.0, 26.5, 27.0]
    volumes = [1000.0] * 175 + [400.0] * 20 + [6000.0] + [1000.0] * 6
    return flat("FLAG", closes, volumes, spread=0.3)


def planted_gap():
    """Flat, then a gap of 30% on ten times the volume that closes at its high and is the pivot."""
    closes = [10.0, 10.05] * 60 + [13.8] + [14.0, 14.2, 14.4, 14.6, 14.8, 15.0, 15.2]
    pdf = flat("GAP", closes, [1000.0] * 120 + [20000.0] + [1000.0] * 7, spread=0.02)
    pdf.loc[120, ["open", "low"]] = [13.3, 13.2]
    return pdf


def test_planted_series_and_reasons(spark):
    import pandas as pd
    bars = frame(spark, pd.concat([planted_flag(), planted_gap(), flat("SLIDE", range(100, 50, -1))]))
    done = prepare(bars)
    found = best_moves(done.bars).select("symbol", "year", "low_date", "high_date")
    extra = spark.createDataFrame([("NONE", 2020, DAY, DAY + dt.timedelta(days=90)), ("SLIDE", 2020, DAY, DAY + dt.timedelta(days=40))],
                                  found.schema)
    got = {r["symbol"]: r for r in rows(classify_moves(found.unionByName(extra), done), "symbol")}
    results = {s: {x["setup"]: x for x in got[s]["ai_all_detector_results"]} for s in ("FLAG", "GAP")}
    assert results["FLAG"]["HTF"]["matched"] and got["FLAG"]["ai_primary"] == "HTF", results["FLAG"]
    assert float(results["FLAG"]["HTF"]["extra"]["pole_gain_pct"]) > 100
    assert results["GAP"]["Gap & Go"]["matched"] and results["GAP"]["Episodic Pivot"]["matched"]
    assert got["GAP"]["ai_primary"] != "Gap & Go"
    assert got["NONE"]["reason"] == "no_csv" and got["NONE"]["needs_review"] and got["NONE"]["ai_classifications"] == []
    assert got["SLIDE"]["reason"] == "no_pivot" and got["SLIDE"]["pivot"] is None
    counted = {r["outcome"]: r["n"] for r in rows(resolve.run_counters(
        classify_moves(found.unionByName(extra), done)), "outcome")}
    assert counted == {"ok": 2, "no_csv": 1, "no_pivot": 1}

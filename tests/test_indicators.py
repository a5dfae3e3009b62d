"""Indicators, swings and pivots against independent pandas and numpy code."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tests.makers import flat, frame, walk
from tidebars.operators import best_moves, indicators, pivots, swings
from tidebars.operators.resample import resample, tick_bars
from tidebars.series import index_series, locate_moves


@pytest.fixture(scope="module")
def pdf():
    return walk("A", 700, 5)


@pytest.fixture(scope="module")
def bars(spark, pdf):
    return index_series(frame(spark, pdf)).cache()


@pytest.fixture(scope="module")
def bench(spark):
    b = walk("B", 400, 6, start="2010-02-10", step=0.01)
    return frame(spark, b[b.index % 3 == 0]).drop("symbol"), b[b.index % 3 == 0]


def test_all_indicators(bars, bench, pdf):
    got = indicators.all_indicators(bars, bench[0]).orderBy("rn").toPandas()
    c, h, low, v = pdf.close, pdf.high, pdf.low, pdf.volume
    prev = c.shift(1)
    tr = pd.concat([h - low, (h - prev).abs(), (low - prev).abs()], axis=1).max(axis=1)
    aligned = bench[1].set_index("ts").close.reindex(pdf.ts, method="ffill").reset_index(drop=True)
    want = {
        "sma50": c.rolling(50).mean(), "sma150": c.rolling(150).mean(), "sma200": c.rolling(200).mean(),
        "ema10": c.ewm(span=10, adjust=False).mean(), "ema20": c.ewm(span=20, adjust=False).mean(),
        "avg_vol_50": v.rolling(50).mean(), "rel_vol": v / v.rolling(50).mean(),
        "adr_pct_20": ((h - low) / c * 100).rolling(20).mean(), "atr_20": tr.rolling(20).mean(),
        "rel_strength_63": (c / c.shift(63)) / (aligned / aligned.shift(63)),
        "high_252": h.rolling(252, min_periods=1).max(), "vol_before_40": v.rolling(40).mean().shift(1),
        "sma50_back": c.rolling(50).mean().shift(21), "close_back_30": c.shift(30),
        "max_down_vol": v.where(c < prev).rolling(10, min_periods=1).max().shift(1),
    }
    for name, series in want.items():
        assert np.allclose(got[name].astype(float), series.to_numpy(float), rtol=1e-10, equal_nan=True), name


@pytest.mark.parametrize("n", [26, 49, 100, 137])
def test_any_span(bars, pdf, n):
    got = indicators.moving_averages(bars, sma=(n,), ema=(n,)).orderBy("rn").toPandas()
    assert np.allclose(got[f"sma{n}"].astype(float), pdf.close.rolling(n).mean(), equal_nan=True)
    assert np.allclose(got[f"ema{n}"], pdf.close.ewm(span=n, adjust=False).mean(), rtol=1e-12)


def test_zero_volume_has_no_ratio(spark):
    bars = index_series(frame(spark, flat("A", [10.0] * 60, [0.0] * 60)))
    got = rows(indicators.volume_baseline(bars), "rn")
    assert got[48]["avg_vol_50"] is None and got[49]["avg_vol_50"] == 0.0
    assert all(r["rel_vol"] is None for r in got)


def test_long_form_has_only_finite_values(bars):
    long = indicators.long_form(indicators.all_indicators(bars))
    assert long.filter("value IS NULL OR isnan(value)").count() == 0
    assert long.filter("indicator = 'sma200'").count() == 501
    assert long.filter("indicator = 'rel_strength_63'").count() == 0


def python_swings(h, low, k=3):
    raw = []
    for i in range(k, len(h) - k):
        sides = [*range(i - k, i), *range(i + 1, i + k + 1)]
        if all(h[i] > h[j] for j in sides):
            raw.append((i + 1, "high", h[i]))
        elif all(low[i] < low[j] for j in sides):
            raw.append((i + 1, "low", low[i]))
    kept = []
    for s in raw:
        if kept and kept[-1][1] == s[1]:
            if (s[2] > kept[-1][2]) if s[1] == "high" else (s[2] < kept[-1][2]):
                kept[-1] = s
        else:
            kept.append(s)
    return kept


def test_swings(bars, pdf):
    got = [(r["rn"], r["kind"], r["price"]) for r in rows(swings.swings(bars), "rn")]
    assert got == python_swings(pdf.high.to_numpy(), pdf.low.to_numpy())
    kinds = [k for _, k, _ in got]
    assert all(a != b for a, b in zip(kinds, kinds[1:]))


def test_swing_ties(spark):
    highs = [1, 2, 3, 9, 3, 2, 1, 2, 3, 9, 3, 2, 1, 1, 5, 5, 1, 1, 1]
    pdf = flat("A", [1.0] * len(highs), spread=0).assign(high=[float(x) for x in highs], low=0.5)
    got = [(r["rn"], r["kind"]) for r in rows(swings.swings(index_series(frame(spark, pdf))), "rn")]
    assert got == [(4, "high")]       # the equal one later loses; twins inside the lookback are no swings


def python_pivot(window, rules=pivots.PivotRules()):
    h, low, c, rv = (window[x].to_numpy() for x in ("high", "low", "close", "rel_vol"))
    best = None
    for i in range(rules.min_base, len(window) - 1):
        if not rv[i] >= rules.min_rel_vol:
            continue
        for n in range(rules.min_base, rules.max_base + 1, rules.stride):
            if n > i:
                continue
            top, bottom = h[i - n:i].max(), low[i - n:i].min()
            depth = (top - bottom) / top
            if depth > rules.max_depth or c[i] <= top:
                continue
            q = 0.45 * (min(n, 50) / 50) + 0.40 * max(0, 1 - depth / rules.max_depth) + 0.15 * min(rv[i] / 3, 1)
            if best is None or q > best[0]:
                best = (q, i, n)
    return best


@pytest.mark.parametrize("rules", [pivots.PivotRules(), pivots.PivotRules(10, 40, 5, 0.4, 1.1)])
def test_pivots(spark, rules):
    pdf = pd.concat([walk(s, 500, seed, step=0.015) for s, seed in (("A", 11), ("B", 12), ("C", 13), ("D", 14))])
    bars = index_series(frame(spark, pdf))
    wide = indicators.all_indicators(bars).cache()
    moves = locate_moves(best_moves.best_moves(bars), bars).cache()
    got = {(r["symbol"], r["year"]): r for r in rows(pivots.pivots(moves, wide, rules), "symbol")}
    local = wide.orderBy("symbol", "rn").toPandas()
    found = 0
    for m in rows(moves, "symbol"):
        window = local[(local.symbol == m["symbol"]) & local.rn.between(m["rn_lo"], m["rn_hi"])]
        want, have = python_pivot(window, rules), got.get((m["symbol"], m["year"]))
        assert (want is None) == (have is None)
        if want:
            found += 1
            assert (have["pivot_idx_in_window"], have["base_len"]) == want[1:]
            assert abs(have["quality_score"] - want[0]) < 1e-12
            assert have["pivot_date"] == window.ts.iloc[want[1]] and have["base_end"] == window.ts.iloc[want[1] - 1]
            assert have["base_start"] == window.ts.iloc[want[1] - want[2]]
    assert found >= 2
    assert rows(pivots.pivot_lookup(moves, pivots.pivots(moves, wide, rules), "a", 1990), "symbol") == []


def test_resample(spark):
    pdf = flat("A", range(10, 24), start="2024-01-01")       # a Monday
    week = rows(resample(frame(spark, pdf), "week"), "ts")
    assert [(r["open"], r["close"], r["volume"], r["bars"]) for r in week] == [(10, 16, 7000, 7), (16, 23, 7000, 7)]
    assert week[1]["high"] == 23.5 and week[1]["low"] == 15.5
    assert len(rows(resample(frame(spark, pdf), "month"), "ts")) == 1


def test_tick_bars(spark):
    ticks = spark.createDataFrame(
        [("A", "2024-01-01 00:00:10", 1, 5.0, 2), ("A", "2024-01-01 00:00:10", 2, 9.0, 1), ("A", "2024-01-01 00:00:50", 3, 7.0, 1),
         ("A", "2024-01-01 00:01:00", 4, 1.0, 1)], "symbol string, ts string, id int, p double, q int",
    ).withColumn("ts", F.to_timestamp("ts"))
    got = rows(tick_bars(ticks, 60, F.col("p"), F.col("q"), F.col("id")), "ts")
    assert [(r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in got] == [(5, 9, 5, 7, 4), (1, 1, 1, 1, 1)]


def test_asof_starts_later(spark):
    bars = index_series(frame(spark, flat("A", [1, 2, 3, 4, 5])))
    bench = spark.createDataFrame([("2020-01-02", 50.0), ("2020-01-04", 60.0)], "ts string, close double").withColumn(
        "ts", F.to_timestamp("ts"))
    aligned = indicators.align_benchmark(bars, bench)
    assert [r["bench_close"] for r in rows(aligned, "rn")] == [None, 50.0, 50.0, 60.0, 60.0]
    over = rows(indicators.benchmark_overlay(aligned), "rn")
    assert [r["rebased"] for r in over] == [50.0, 100.0, 150.0, 200.0, 250.0]
    assert [r["bench_rebased"] for r in over] == [None, 100.0, 100.0, 120.0, 120.0]


@pytest.mark.parametrize("chunk", [64, 8192])
def test_any_spans_equal_pandas(spark, chunk):
    pdf = walk("A", 700, 5)
    spans = (1, 2, 5, 10, 20, 200, 250)
    cut = index_series(frame(spark, pdf), chunk_rows=chunk)
    got = indicators.moving_averages(cut, sma=(3, 300), ema=spans, chunk_rows=chunk).orderBy("rn").toPandas()
    for n in spans:
        assert np.allclose(got[f"ema{n}"], pdf.close.ewm(span=n, adjust=False).mean(), rtol=1e-10)
    assert np.allclose(got.sma300, pdf.close.rolling(300).mean(), equal_nan=True)


def test_benchmark_by_day_equals_asof(spark):
    times = pd.to_datetime(["2019-11-03 10:00", "2019-11-03 15:00", "2020-02-01 09:00", "2022-05-05 00:00", "2022-05-07 23:00"])
    bench = pd.DataFrame({"ts": times, "close": [1.0, 2.0, 3.0, 4.0, 5.0]})
    bars = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2019-10-30 12:30", "2022-12-31", freq="31h"), "close": 1.0})
    want = pd.merge_asof(bars, bench.rename(columns={"close": "bench_close"}), on="ts")
    empty = spark.createDataFrame([], "ts timestamp, close double")
    got = indicators.align_benchmark(spark.createDataFrame(bars), spark.createDataFrame(bench)).orderBy("ts").toPandas()
    assert np.allclose(got.bench_close.astype(float), want.bench_close, equal_nan=True)
    assert indicators.align_benchmark(spark.createDataFrame(bars), empty).filter("bench_close is not null").count() == 0

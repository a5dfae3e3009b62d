"""Maintained tables, moves and their repair, analytics and the stream."""
import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tests.makers import flat, frame, walk
from tidebars.operators import analytics as a
from tidebars.operators import best_moves as bm
from tidebars.operators import indicators, tables
from tidebars.plans.pipeline import prepare, repair_moves, report_moves
from tidebars.series import index_series, locate_moves, move_bars
from tidebars.streaming import extend


def day(d, year=2020):
    return dt.datetime(year, 1, d)


# ---------- best moves and repair ----------

def moves_of(spark, closes, **kw):
    return rows(bm.best_moves(index_series(frame(spark, flat("A", closes, **kw)))), "year")


def test_best_move_cases(spark):
    assert moves_of(spark, [5, 4, 3, 2]) == []
    assert moves_of(spark, [3, 3, 3]) == []
    one = moves_of(spark, [2, 3, 4])[0]
    assert (one["low_date"], one["high_date"], one["gain_pct"]) == (day(1), day(3), 100.0)
    tied = moves_of(spark, [2, 4, 1, 2, 1, 2])[0]         # three gains of 100%: the earliest high
    assert (tied["low_date"], tied["high_date"]) == (day(1), day(2))
    late = moves_of(spark, [9, 2, 2, 3, 1, 1.2])[0]       # the lowest low comes after the best high
    assert (late["low_date"], late["high_date"], late["low_price"]) == (day(2), day(4), 2)


def test_best_move_per_year_against_brute_force(spark):
    pdf = pd.concat([walk("A", 900, 3), walk("B", 500, 4)])
    got = rows(bm.best_moves(index_series(frame(spark, pdf))), "symbol", "year")
    want = []
    for (symbol, year), g in pdf.groupby(["symbol", pdf.ts.dt.year]):
        c = g.close.to_numpy()
        best = max(((c[j] / c[i] - 1) * 100, -j, -i) for i in range(len(c)) for j in range(i, len(c)))
        if best[0] > 0:
            want.append((symbol, year, best[0], g.ts.iloc[-best[1]]))
    assert [(r["symbol"], r["year"]) for r in got] == [w[:2] for w in want]
    assert np.allclose([r["gain_pct"] for r in got], [w[2] for w in want])
    assert [r["high_date"] for r in got] == [w[3] for w in want]


@pytest.fixture(scope="module")
def crossing(spark):
    closes = {2018: [10, 11, 12, 11], 2019: [12, 14, 13, 15], 2020: [15, 18, 20, 19]}
    parts = [flat("A", c, start=f"{y}-03-01") for y, c in closes.items()]
    parts += [flat("DOWN", [9, 8, 7], start="2019-03-01"), flat("DOWN", [7, 6, 5], start="2020-03-01")]
    bars = index_series(frame(spark, pd.concat(parts)))
    data = [
        (2018, "A", 100.0, "2018-03-01", "2020-03-03", "seen"), (2019, "A", 25.0, "2019-03-01", "2019-03-04", "old"),
        (2019, "DOWN", 1.0, "2020-03-01", "2019-03-01", "back"), (2020, "NONE", 1.0, "2019-12-01", "2020-02-01", "none"),
        (2020, "B", 1.0, "2020-01-01", "2020-02-01", "fine"),
    ]
    moves = spark.createDataFrame(data, "year int, symbol string, gain_pct double, low_date string, high_date string, tag string")
    moves = moves.withColumns({"low_date": F.to_timestamp("low_date"), "high_date": F.to_timestamp("high_date"),
                               "low_price": F.lit(1.0), "high_price": F.lit(2.0), "avg_vol_b": F.lit(0.0)})
    return moves, bars


def test_repair(spark, crossing):
    moves, bars = crossing
    assert {r["symbol"] for r in rows(bm.cross_period(moves), "symbol")} == {"A", "DOWN", "NONE"}
    covered = rows(bm.periods_covered(bm.cross_period(moves)), "symbol", "covered")
    assert [(r["symbol"], r["covered"]) for r in covered] == [
        ("A", 2018), ("A", 2019), ("A", 2020), ("DOWN", 2019), ("DOWN", 2020), ("NONE", 2019), ("NONE", 2020)]
    plan, fixed = repair_moves(moves, bars)
    got = {(r["symbol"], r["covered"]): (r["action"], r["reason"]) for r in rows(plan, "symbol")}
    assert got == {
        ("A", 2018): ("REWRITE", None), ("A", 2019): ("SKIP", "exists"), ("A", 2020): ("ADD", None),
        ("DOWN", 2019): ("SKIP", "no_move"), ("DOWN", 2020): ("SKIP", "no_move"),
        ("NONE", 2019): ("SKIP", "no_bars"), ("NONE", 2020): ("SKIP", "no_bars")}
    table = fixed.collect()
    assert [(r.year, r.symbol) for r in table] == [(2018, "A"), (2019, "A"), (2019, "DOWN"), (2020, "A"), (2020, "B"), (2020, "NONE")]
    assert table[0].gain_pct == 20.0 and table[0].tag == "seen" and table[3].tag == "seen" and table[3].gain_pct == 33.33
    assert {(r["action"], r["reason"]): r["n"] for r in rows(bm.repair_summary(plan), "n")}[("SKIP", "no_bars")] == 2


# ---------- merges ----------

def test_merge_keeps_human_fields(spark):
    fresh = spark.createDataFrame([("A_1", "VCP", None), ("B_1", None, "no_pivot")], "move_key string, ai_primary string, reason string")
    prior = spark.createDataFrame([("A_1", "HTF", "old", "mine"), ("C_1", "EP", "old", None)],
                                  "move_key string, ai_primary string, reason string, user_note string")
    got = [tuple(r.values()) for r in rows(tables.merge_classifications(fresh, prior), "move_key")]
    assert got == [("A_1", "VCP", None, "mine"), ("B_1", None, "no_pivot", None), ("C_1", "EP", "old", None)]
    assert tables.merge_classifications(fresh, None) is fresh


def test_overrides(spark):
    base = spark.createDataFrame([("A_1", "VCP", "was"), ("B_1", "EP", None)], "move_key string, ai_primary string, user_note string")
    posts = spark.createDataFrame(
        [("A_1", day(1), "HTF", "x", "first"), ("A_1", day(2), None, None, None), ("N_1", day(3), "VCP", None, "new")],
        "move_key string, saved_at timestamp, user_primary string, user_secondary string, user_note string")
    got = {r["move_key"]: r for r in rows(tables.apply_overrides(base, posts), "move_key")}
    assert got["A_1"]["user_primary"] is None and got["A_1"]["user_secondary"] == "x" and got["A_1"]["user_note"] == "first"
    assert got["A_1"]["user_reviewed"] and got["A_1"]["user_reviewed_at"] == dt.date(2020, 1, 2)
    assert got["B_1"]["user_reviewed"] is None and got["N_1"]["ai_primary"] is None and got["N_1"]["user_note"] == "new"


def test_move_rows(spark):
    moves = spark.createDataFrame([("A", 1, 5.0, "keep"), ("B", 1, 6.0, "b")], "symbol string, year int, gain_pct double, note string")
    new = spark.createDataFrame([("A", 1, 9.0), ("C", 2, 1.0)], "symbol string, year int, gain_pct double")
    got = [tuple(r.values()) for r in rows(tables.upsert_moves(moves, new), "symbol")]
    assert got == [("A", 1, 9.0, "keep"), ("B", 1, 6.0, "b"), ("C", 2, 1.0, None)]
    gone = spark.createDataFrame([("A", 1, True), ("B", 2, False)], "symbol string, year int, delete_bars boolean")
    assert [r["symbol"] for r in rows(tables.remove_moves(moves, gone), "symbol")] == ["B"]
    bars = frame(spark, pd.concat([flat("A", [1]), flat("B", [1])]))
    assert [r["symbol"] for r in rows(tables.remove_bars(bars, gone), "symbol")] == ["B"]


def feed_rows(spark, *items):
    return spark.createDataFrame([(s, day(d), c, c, c, c, 5.0, q) for s, d, c, q in items],
                                 "symbol string, ts timestamp, open double, high double, low double, close double, volume double, seq int")


def test_extend(spark):
    bars = frame(spark, flat("A", [1, 2, 3])).filter(F.dayofmonth("ts") != 2)
    feed = feed_rows(spark, ("A", 2, 8.0, 1), ("A", 3, 9.0, 1), ("A", 4, 4.0, 1), ("A", 4, 4.5, 2), ("A", 5, 0.0, 1), ("B", 1, 7.0, 1))
    got = [(r["symbol"], r["ts"].day, r["close"]) for r in rows(tables.extend_bars(bars, feed), "symbol", "ts")]
    assert got == [("A", 1, 1.0), ("A", 3, 3.0), ("A", 4, 4.5), ("B", 1, 7.0)]
    filled = [(r["symbol"], r["ts"].day, r["close"]) for r in rows(tables.fill_bars(bars, feed), "symbol", "ts")]
    assert filled == [("A", 1, 1.0), ("A", 2, 8.0), ("A", 3, 3.0), ("A", 4, 4.5), ("B", 1, 7.0)]


def test_feed_needs_an_order(spark):
    feed = feed_rows(spark, ("A", 1, 10.0, 1), ("A", 1, 9.0, 2))
    assert [r.close for r in tables.clean_feed(feed).collect()] == [9.0]
    with pytest.raises(ValueError, match="seq"):
        tables.clean_feed(feed.drop("seq"))


def test_upsert_moves_takes_one_row_a_key(spark):
    moves = spark.createDataFrame([("A", 2023, 1.0), ("A", 2024, 2.0)], "symbol string, year int, gain_pct double")
    posts = spark.createDataFrame([("A", 2024, 5.0, 1), ("A", 2024, 4.0, 2)], "symbol string, year int, gain_pct double, saved_at int")
    assert [(r["year"], r["gain_pct"]) for r in rows(tables.upsert_moves(moves, posts), "year")] == [(2023, 1.0), (2024, 4.0)]
    assert tables.upsert_moves(moves, posts.drop("saved_at")).count() == 2


def test_merge_keeps_columns_only_prior_has(spark):
    fresh = spark.createDataFrame([("A", "VCP")], "move_key string, ai_primary string")
    prior = spark.createDataFrame([("A", "x", "note"), ("B", "y", "old")], "move_key string, ai_primary string, remark string")
    got = [(r["move_key"], r["ai_primary"], r["remark"]) for r in rows(tables.merge_classifications(fresh, prior), "move_key")]
    assert got == [("A", "VCP", "note"), ("B", "y", "old")]


def test_best_move_after_a_zero_close(spark):
    assert moves_of(spark, [0, *range(1, 40)]) == []
    before = moves_of(spark, [2, 3, 0, 50])[0]
    assert (before["gain_pct"], before["high_date"]) == (50.0, day(2))


def test_range_summary(spark):
    got = tables.range_summary(frame(spark, flat("A", [5, 9, 4, 9, 4], [1e9] * 5))).first()
    assert (got.low_date, got.high_date, got.low_price, got.high_price) == (day(3), day(2), 4.0, 9.0)
    assert got.gain_pct == 125.0 and got.avg_vol_b == 1.0 and got.total_bars == 5


def test_saves(spark):
    reviews = spark.createDataFrame([("A_1", 1.0), ("B_1", 2.0)], "move_key string, gain_pct double")
    posts = spark.createDataFrame([("A_1", 5.0, 1), ("A_1", 6.0, 2), ("C_1", 7.0, 1)], "move_key string, gain_pct double, saved_at int")
    assert [r["gain_pct"] for r in rows(tables.save_reviews(reviews, posts), "move_key")] == [6.0, 2.0, 7.0]
    assert [r["move_key"] for r in rows(tables.save_annotations(reviews, posts, whole=True), "move_key")] == ["A_1", "C_1"]


# ---------- analytics ----------

def python_stats(w):
    top = w.close.cummax()
    dd = (w.low - top) / top
    return {
        "days": len(w), "ema10_pct": (w.close >= w.ema10).mean() * 100, "ema20_pct": (w.close >= w.ema20).mean() * 100,
        "sma50_touches": int(((w.close - w.sma50).abs() / w.sma50 < 0.03).sum()), "days_below_50": int((w.close < w.sma50).sum()),
        "worst_dd_pct": dd.min() * 100, "days_u10": int((dd < -0.1).sum()), "pct_u10": (dd < -0.1).mean() * 100,
        "adr": w.adr_pct_20.mean(), "px_start": w.close.iloc[0], "px_end": w.close.iloc[-1], "low": w.low.min(), "high": w.high.max(),
    }


def python_streak(above):
    best, start, run = (0, 0), 0, 0
    for i, v in enumerate(above):
        run = run + 1 if v else 0
        start = start if run > 1 else i
        if run > best[0]:
            best = (run, start)
    return best


def test_report_against_pandas(spark):
    pdf = pd.concat([walk("A", 700, 21, step=0.04), walk("B", 300, 22, step=0.04)])
    done = prepare(frame(spark, pdf))
    moves = bm.best_moves(done.bars)
    report = report_moves(moves, done)
    local = done.frame.orderBy("symbol", "rn").toPandas()
    located = rows(locate_moves(moves, done.bars), "symbol", "year")
    stats = {(r["symbol"], r["year"]): r for r in rows(report.stats, "symbol")}
    quarters = {(r["symbol"], r["year"], r["quarter"]): r for r in rows(report.quarters, "symbol")}
    streaks = {(r["symbol"], r["year"]): r for r in rows(report.streaks, "symbol")}
    slopes = {(r["symbol"], r["year"]): r for r in rows(report.slopes, "symbol")}
    gaps = {(r["symbol"], r["year"], r["ts"]): r for r in rows(report.gaps, "symbol")}
    n_gaps = 0
    for m in located:
        key = (m["symbol"], m["year"])
        w = local[(local.symbol == m["symbol"]) & local.rn.between(m["rn_lo"], m["rn_hi"])].reset_index(drop=True)
        for name, value in python_stats(w).items():
            assert stats[key][name] is None and pd.isna(value) or np.isclose(stats[key][name], value), name
        n = len(w)
        for k, (i, j) in enumerate([(0, n // 4), (n // 4, n // 2), (n // 2, 3 * n // 4), (3 * n // 4, n)], 1):
            if i < j:
                assert np.isclose(quarters[(*key, k)]["worst_dd_pct"], python_stats(w.iloc[i:j])["worst_dd_pct"])
                assert quarters[(*key, k)]["days"] == j - i
            else:
                assert (*key, k) not in quarters
        length, start = python_streak(w.close >= w.ema10)
        assert (streaks[key]["streak_days"], streaks[key]["streak_start"]) == (length, w.ts[start])
        if n > 1:
            assert np.isclose(slopes[key]["slope"], np.polyfit(range(n), w.close, 1)[0])
        gap = (w.open - w.close.shift(1)) / w.close.shift(1) * 100
        rel = w.volume / w.volume.rolling(20).mean()
        for i in np.flatnonzero((gap >= 5) & (rel >= 1.5)):
            n_gaps += 1
            got = gaps[(*key, w.ts[i])]
            cp = (w.close[i] - w.low[i]) / (w.high[i] - w.low[i]) * 100
            assert np.isclose(got["close_pct"], cp) and got["label"] == ("REAL" if cp > 70 else "TRAP" if cp < 30 else "MID")
    assert n_gaps == len(gaps) > 0
    assert report.screen.count() == len(located)


@pytest.mark.parametrize("n, want", [(1, [4]), (3, [2, 3, 4]), (4, [1, 2, 3, 4]), (7, [1, 2, 2, 3, 3, 4, 4])])
def test_quarters(spark, n, want):
    got = [r.q for r in spark.range(n).select(a.quarter_of(F.col("id"), F.lit(n)).alias("q")).collect()]
    assert sorted(got) == want


def test_streak_ties_and_none(spark):
    bars = index_series(frame(spark, flat("A", [10, 9, 8, 12, 13, 5, 20, 21, 4, 3])))
    wide = indicators.all_indicators(bars)
    moves = spark.createDataFrame([("A", 1, day(1), day(10)), ("A", 2, day(2), day(3))],
                                  "symbol string, year int, low_date timestamp, high_date timestamp")
    got = rows(a.longest_streak(move_bars(locate_moves(moves, bars), wide)), "year")
    assert [(r["year"], r["streak_days"], r["streak_start"].day) for r in got] == [(1, 2, 4)]


def test_agreement(spark):
    machine = spark.createDataFrame([("A", 1, "Episodic Pivot"), ("B", 1, None), ("C", 1, "VCP"), ("D", 1, "VCP")],
                                    "symbol string, year int, ai_primary string")
    human = spark.createDataFrame([("A", 1, ["EP", "Breakout"], None), ("B", 1, ["Breakout"], None), ("C", 1, ["VCP"], "HTF"),
                                   ("D", 1, None, None)], "symbol string, year int, tags array<string>, user_primary string")
    got = rows(a.agreement(machine, human), "symbol")
    assert [r["agrees"] for r in got] == [True, True, False, False]
    counts = {(r["machine"], r["human"]): r["n"] for r in rows(a.confusion(a.agreement(machine, human)), "n")}
    assert counts == {("Episodic Pivot", "Episodic Pivot"): 1, ("(none)", "(none)"): 1, ("VCP", "HTF"): 1, ("VCP", "(none)"): 1}


# ---------- stream ----------

def drain(spark, table, feed, check, files=100):
    extend.extend_stream(extend.read_feed(spark, feed, files), table, check, once=True).awaitTermination()
    return [(r["symbol"], r["ts"].day, r["close"]) for r in rows(extend.read_table(spark, table), "symbol", "ts")]


@pytest.mark.parametrize("files", [1, 100])
def test_stream_keeps_late_and_corrected_bars(spark, tmp_path, files):
    table, feed, check = (str(tmp_path / x) for x in ("table", "feed", "check"))
    extend.start_table(frame(spark, flat("A", [1])), table)
    for part in ([("A", 28, 5.0, 1), ("B", 28, -3.0, 1)], [("B", 28, 3.0, 1), ("NEW", 2, 7.0, 1)], [("NEW", 1, 6.0, 1)]):
        feed_rows(spark, *part).drop("seq").coalesce(1).write.mode("append").parquet(feed)
    assert drain(spark, table, feed, check, files) == [
        ("A", 1, 1.0), ("A", 28, 5.0), ("B", 28, 3.0), ("NEW", 1, 6.0), ("NEW", 2, 7.0)]


def test_feeds_do_not_overwrite_each_other(spark, tmp_path):
    table = str(tmp_path / "table")
    extend.start_table(frame(spark, flat("A", [1])), table)
    for k in (2, 3):
        feed, check = str(tmp_path / f"feed{k}"), str(tmp_path / f"check{k}")
        feed_rows(spark, ("A", k, float(k), 1)).drop("seq").write.parquet(feed)
        got = drain(spark, table, feed, check)
    assert got == [("A", 1, 1.0), ("A", 2, 2.0), ("A", 3, 3.0)]


def test_stream_is_idempotent(spark, tmp_path):
    table, feed_dir, check = (str(tmp_path / x) for x in ("table", "feed", "check"))
    extend.start_table(frame(spark, flat("A", [1, 2])), table)
    first = feed_rows(spark, ("A", 2, 9.0, 1), ("A", 3, 3.0, 1), ("B", 1, 7.0, 1)).drop("seq")
    first.coalesce(1).write.parquet(feed_dir)
    extend.extend_stream(extend.read_feed(spark, feed_dir), table, check, once=True).awaitTermination()
    first.union(feed_rows(spark, ("A", 4, 4.0, 1)).drop("seq")).coalesce(1).write.mode("append").parquet(feed_dir)
    extend.extend_stream(extend.read_feed(spark, feed_dir), table, check, once=True).awaitTermination()
    want = [("A", 1, 1.0), ("A", 2, 2.0), ("A", 3, 3.0), ("A", 4, 4.0), ("B", 1, 7.0)]

    def have():
        return [(r["symbol"], r["ts"].day, r["close"]) for r in rows(extend.read_table(spark, table), "symbol", "ts")]
    assert have() == want
    again = first.withColumn("seq", F.lit(1))
    extend.add_batch(again, 0, table, extend.feed_id(spark, check))        # the first batch again, as after a failure
    assert have() == want

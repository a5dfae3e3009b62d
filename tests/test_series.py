"""The chunked layout gives the same results however the series is cut."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tests.makers import flat, frame, walk
from tidebars.operators import analytics, best_moves, features, indicators, pivots, swings
from tidebars.series import Running, chunk_bounds, index_series, locate_moves, move_bars, running, with_halo

N = 2600
CUT = 900


@pytest.fixture(scope="module")
def pdf():
    return pd.concat([walk("HOT", N, 1), walk("COLD", 120, 2)])


@pytest.fixture(scope="module")
def whole(spark, pdf):
    return index_series(frame(spark, pdf)).cache()


@pytest.fixture(scope="module")
def cut(spark, pdf):
    return index_series(frame(spark, pdf), chunk_rows=CUT).cache()


def test_row_numbers_are_dense(cut, pdf):
    got = cut.orderBy("symbol", "ts").toPandas()
    for symbol, n in (("HOT", N), ("COLD", 120)):
        rn = got[got.symbol == symbol].rn.to_numpy()
        assert (rn == np.arange(1, n + 1)).all()
    assert (got.chunk == (got.rn - 1) // CUT).all()
    assert cut.groupBy("symbol", "chunk").count().agg(F.max("count")).first()[0] <= CUT


def test_halo_copies_only_edges(cut):
    copied = with_halo(cut, before=50, after=3, chunk_rows=CUT)
    assert copied.filter("is_core").count() == cut.count()
    # three chunks: the tails of all full chunks go on, the heads of the later ones go back
    assert copied.filter("NOT is_core").count() == 2 * 50 + 2 * 3
    # a halo wider than a chunk comes from several chunks
    wide = with_halo(cut, before=2 * CUT, chunk_rows=CUT).filter("chunk = 2 and symbol = 'HOT'")
    assert wide.filter("NOT is_core").count() == 2 * CUT and wide.filter("is_core").count() == cut.filter("chunk = 2").count()


def test_running_matches_pandas(cut, pdf):
    got = running(cut, ["symbol"], [
        Running("s", "sum", F.col("volume")), Running("m", "max", F.col("close")),
        Running("before", "last", F.when(F.col("close") > F.col("open"), F.col("close")), exclusive=True),
    ]).orderBy("symbol", "rn").toPandas()
    for symbol in ("HOT", "COLD"):
        want, have = pdf[pdf.symbol == symbol], got[got.symbol == symbol].reset_index(drop=True)
        assert np.allclose(have.s, want.volume.cumsum().to_numpy())
        assert np.allclose(have.m, want.close.cummax().to_numpy())
        last = want.close.where(want.close > want.open).ffill().shift(1).to_numpy()
        assert np.allclose(have.before.astype(float), last, equal_nan=True)


def same(a, b, keys):
    a, b = a.orderBy(*keys).toPandas(), b.orderBy(*keys).toPandas()
    pd.testing.assert_frame_equal(a[sorted(a.columns)], b[sorted(b.columns)], rtol=1e-9, atol=1e-9)


def test_everything_is_the_same_in_any_cut(spark, whole, cut):
    frames, tables = [], []
    for bars, size in ((whole, 8192), (cut, CUT)):
        s = swings.swings(bars, chunk_rows=size)
        wide = features.attach_swings(indicators.all_indicators(bars, chunk_rows=size), s).cache()
        moves = locate_moves(best_moves.best_moves(bars), bars, chunk_rows=size).cache()
        p = pivots.pivots(moves, wide, chunk_rows=size).cache()
        inside = move_bars(moves, wide, size).cache()
        frames.append(wide.drop("chunk"))
        tables.append((
            s.drop("chunk"), moves, p, features.move_features(p, wide, size), analytics.window_stats(inside),
            analytics.longest_streak(inside), analytics.quarter_stats(inside), analytics.retracements(moves, s, size),
        ))
    same(frames[0], frames[1], ["symbol", "rn"])
    assert tables[0][2].count() > 0
    for a, b in zip(*tables):
        a = a.select(*[c for c, t in a.dtypes if not t.startswith(("array", "struct"))])
        b = b.select(*a.columns)
        keys = [c for c in ("symbol", "year", "rn", "quarter") if c in a.columns]
        same(a, b, keys)


def test_moves_on_days_without_bars(spark, cut):
    moves = spark.createDataFrame(
        [("COLD", 1, "2010-01-01", "2010-01-10"), ("COLD", 2, "2030-01-01", "2030-02-01"), ("NONE", 3, "2010-01-01", "2010-02-01")],
        "symbol string, year int, low_date string, high_date string",
    ).withColumns({c: F.to_timestamp(c) for c in ("low_date", "high_date")})
    got = rows(locate_moves(moves, cut, chunk_rows=CUT), "year")
    assert [(r["rn_lo"], r["rn_hi"], r["n_bars"]) for r in got] == [(1, 7, 7), (None, None, None), (None, None, None)]
    assert chunk_bounds(cut).count() == 4


def test_shuffle_count_does_not_matter(spark, pdf):
    got = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(indicators.all_indicators(index_series(frame(spark, pdf))).orderBy("symbol", "rn").toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    pd.testing.assert_frame_equal(*got)


def test_short_series(spark):
    bars = index_series(frame(spark, flat("A", [10, 11, 12])))
    got = rows(indicators.all_indicators(bars), "rn")
    assert [r["sma50"] for r in got] == [None] * 3
    assert got[0]["ema10"] == 10 and got[0]["true_range"] == 1.0 and got[0]["gap_pct"] is None
    assert swings.swings(bars).count() == 0

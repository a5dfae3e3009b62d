"""Best moves of ranges from chunk summaries against the bars of each range."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.makers import frame, walk
from tidebars.operators import best_moves as bm
from tidebars.operators import range_moves as rm
from tidebars.series import index_series


def best(g):
    """(gain, low date, high date, low, high) of one range; a low at or below zero ends the gains."""
    found, low = None, None
    for r in g[g.close.notna()].sort_values("ts").itertuples():
        if low is None or r.close < low.close:
            low = r
        if low.close <= 0:
            continue
        gain = (r.close / low.close - 1) * 100
        if found is None or gain > found[0]:
            found = gain, low.ts, r.ts, low.close, r.close
    return found if found is not None and found[0] > 0 else None


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(4)
    parts = [walk("A", 400, 1), walk("B", 90, 2), walk("C", 1, 3), walk("D", 150, 4)]
    parts[1]["close"] = parts[1]["close"].round(0)     # ties
    parts[3].loc[40:60, "close"] = np.nan
    parts[3].loc[100, "close"] = 0.0
    out = pd.concat(parts, ignore_index=True)
    out.loc[rng.random(len(out)) < 0.05, "volume"] = np.nan
    return out


@pytest.mark.parametrize("chunk", [7, 32, 8192])
def test_ranges(spark, pdf, chunk):
    rng = np.random.default_rng(chunk)
    bars = index_series(frame(spark, pdf).replace(float("nan"), None), chunk_rows=chunk).cache()
    rows = []
    for i in range(120):
        symbol = rng.choice(list("ABCD"))
        a, b = sorted(rng.integers(0, 410, 2).tolist())
        rows.append((symbol, i, (pdf.ts.min() + pd.Timedelta(days=a)).to_pydatetime(), (pdf.ts.min() + pd.Timedelta(days=b)).to_pydatetime()))
    spans = spark.createDataFrame(rows, "symbol string, year int, from_ts timestamp, to_ts timestamp")
    held = rm.chunk_summaries(bars).cache()
    got = {(r.symbol, r.year): r for r in rm.best_in(spans, bars, held, chunk_rows=chunk).collect()}
    want = {}
    for symbol, i, a, b in rows:
        g = pdf[(pdf.symbol == symbol) & (pdf.ts >= a) & (pdf.ts <= b)]
        if (found := best(g)) is not None:
            want[symbol, i] = (*found, g.volume.mean() / 1e9)
    assert set(got) == set(want)
    for key, w in want.items():
        r = got[key]
        assert (r.low_date, r.high_date, r.low_price, r.high_price) == (w[1], w[2], w[3], w[4])
        assert abs(r.gain_pct - w[0]) < 1e-9 and abs(r.avg_vol_b - w[5]) < 1e-15


def test_what_is_read_grows_with_the_ends(spark, pdf):
    bars = index_series(frame(spark, pdf).replace(float("nan"), None), chunk_rows=7).cache()
    spans = spark.createDataFrame([("A", i, pdf.ts.min().to_pydatetime(), (pdf.ts.min() + pd.Timedelta(days=395)).to_pydatetime()) for i in range(5)],
                                  "symbol string, year int, from_ts timestamp, to_ts timestamp")
    from tidebars.series import locate_moves
    located = locate_moves(spans, bars, key=["symbol", "year"], low="from_ts", high="to_ts", chunk_rows=7)
    pieces = rm.pieces_of(located, bars, rm.chunk_summaries(bars), ["symbol", "year"], 7)
    assert pieces.count() == 5 * 57     # one piece a chunk, of 396 bars each


def test_repair_by_summaries(spark, pdf):
    bars = index_series(frame(spark, pdf).replace(float("nan"), None), chunk_rows=32).cache()
    moves = bm.rounded_moves(bm.best_moves(bars, F.lit(0)).withColumn("year", F.year("low_date")))
    held = rm.chunk_summaries(bars)
    plain = bm.repair_plan(moves, bars)
    quick = bm.repair_plan(moves, bars, search=lambda asked: rm.best_of_periods(asked, bars, held, chunk_rows=32))
    order = ["symbol", "year", "covered"]
    assert plain.count() > 0
    assert [r.asDict() for r in plain.orderBy(*order).collect()] == [r.asDict() for r in quick.select(*plain.columns).orderBy(*order).collect()]

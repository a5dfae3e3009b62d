"""Trend bands against a plain loop, in one chunk and in several."""
import numpy as np
import pandas as pd
import pytest

from tests.makers import frame, walk
from tidebars.functions import ratchet
from tidebars.operators import indicators
from tidebars.operators import supertrend as st
from tidebars.series import index_series

FACTORS = (1.0, 2.0, 4.0, 30.0)     # the last is so wide that a chunk does not forget its start


def loop(g, factor):
    """(rn, trend, line) of one symbol."""
    out, state = [], None
    prev = None
    for r in g.itertuples():
        if not np.isnan(r.atr_20):
            mid = (r.high + r.low) / 2
            up, down = mid + factor * r.atr_20, mid - factor * r.atr_20
            if state is None:
                u, low, t = up, down, 1
            else:
                u, low, t = state
                u = up if up < u or prev > u else u
                low = down if down > low or prev < low else low
                t = 1 if r.close > u else -1 if r.close < low else t
            state = (u, low, t)
            out.append((r.rn, t, low if t > 0 else u, r.close))
        prev = r.close
    return out


def best_factor(performances, factors):
    """Largest spread between three runs of the performances in order, by trying all cuts."""
    order = sorted(range(len(factors)), key=lambda i: (round(performances[i] / st.TICK), factors[i]))
    p, f = [round(performances[i] / st.TICK) for i in order], [factors[i] for i in order]
    best = None
    for i in range(1, len(p) - 1):
        for j in range(i + 1, len(p)):
            runs = p[:i], p[i:j], p[j:]
            spread = sum(sum(run) ** 2 / len(run) for run in runs)
            if best is None or spread > best[0]:
                best = spread, sum(f[j:]) / len(f[j:])
    return best[1]


def adaptive_loop(g, factors, memory):
    """(rn, factor, trend, line) of one symbol: everything from bars up to the present one."""
    tried = [loop(g, f) for f in factors]
    banded = g[g.atr_20.notna()]
    scores, out, state, before = [0.0] * len(factors), [], None, None
    for k, r in enumerate(banded.itertuples()):
        for i, run in enumerate(tried):
            x = run[k - 1][1] * (run[k][3] - run[k - 1][3]) if k else 0.0
            scores[i] = x if k == 0 else scores[i] + 2 / (memory + 1) * (x - scores[i])
        factor = best_factor(scores, factors)
        mid = (r.high + r.low) / 2
        up, down = mid + factor * r.atr_20, mid - factor * r.atr_20
        if state is None:
            u, low, t = up, down, 1
        else:
            u, low, t = state
            u = up if up < u or before > u else u
            low = down if down > low or before < low else low
            t = 1 if r.close > u else -1 if r.close < low else t
        state, before = (u, low, t), r.close
        out.append((r.rn, factor, t, low if t > 0 else u))
    return out


@pytest.fixture(scope="module")
def pdf():
    return pd.concat([walk("A", 1900, 31), walk("B", 300, 32), walk("C", 10, 33)])


@pytest.mark.parametrize("chunk", [8192, 600])
def test_bands(spark, pdf, chunk):
    bars = index_series(frame(spark, pdf), chunk_rows=chunk)
    wide = indicators.range_measures(bars, chunk_rows=chunk).selectExpr(
        "*", "lag(close) OVER (PARTITION BY symbol ORDER BY rn) AS prev_close").cache()
    local = wide.orderBy("symbol", "rn").toPandas()
    got = st.trend_bands(wide, FACTORS).orderBy("symbol", "rn").toPandas()
    adaptive = st.adaptive_bands(wide, FACTORS, memory=10, chunk_rows=chunk).orderBy("symbol", "rn").toPandas()
    assert set(got.symbol) == {"A", "B"}
    for symbol in ("A", "B"):
        g, have = local[local.symbol == symbol], got[got.symbol == symbol]
        for i, f in enumerate(FACTORS):
            want = loop(g, f)
            assert have.rn.tolist() == [w[0] for w in want]
            assert [x[i] for x in have.trend] == [w[1] for w in want]
            assert np.allclose([x[i] for x in have.line], [w[2] for w in want])
        mine, want = adaptive[adaptive.symbol == symbol], adaptive_loop(g, FACTORS, 10)
        assert mine.rn.tolist() == [w[0] for w in want]
        assert np.allclose(mine.factor, [w[1] for w in want])
        assert mine.trend.tolist() == [w[2] for w in want] and np.allclose(mine.line, [w[3] for w in want])


def test_later_bars_change_nothing_before(spark, pdf):
    def run(rows):
        bars = index_series(frame(spark, rows), chunk_rows=600)
        wide = indicators.range_measures(bars, chunk_rows=600).selectExpr("*", "lag(close) OVER (PARTITION BY symbol ORDER BY rn) AS prev_close")
        return st.adaptive_bands(wide, FACTORS, chunk_rows=600).toPandas().set_index(["symbol", "rn"])[["factor", "trend", "line"]]

    whole, cut = run(pdf), run(pd.concat([pdf[pdf.symbol == "A"].head(700), pdf[pdf.symbol == "B"]]))
    pd.testing.assert_frame_equal(cut.sort_index(), whole.loc[cut.index].sort_index())


def bars_of(rng, n, drift=0.0):
    close = 100 + np.cumsum(rng.normal(drift, 1, n)).round(1)
    prev = np.concatenate([[100.0], close[:-1]])
    width = rng.uniform(0.1, 6) * rng.uniform(0.5, 1.5, n).round(1)
    return (close + width).tolist(), (close - width).tolist(), prev.tolist(), close.tolist()


@pytest.mark.parametrize("drift", [0.0, 0.8, -0.8])
def test_functions_of_chunks(drift):
    """A function of many bars gives what the bars give one by one, from any state."""
    for seed in range(60):
        rng = np.random.default_rng(seed)
        upper, lower, prev, close = bars_of(rng, int(rng.integers(1, 80)), drift)
        if seed % 5 == 0:
            prev[len(prev) // 2] = float("nan")
            close[-1] = float("nan")
        up = ratchet.follow(upper, prev, close, range(len(close)))
        down = ratchet.follow([-x for x in lower], [-x for x in prev], [-x for x in close], range(len(close)))
        assert up.start == sorted(up.start) and len(up.start) <= len(close) + 3
        for _ in range(60):
            state = round(float(rng.normal(105, 12)), 1), round(float(rng.normal(95, 12)), 1), int(rng.choice([-1, 1]))
            assert ratchet.end_state(state, up, down) == ratchet.states(state, zip(upper, lower, prev, close))[-1]


def test_functions_run_together():
    upper, lower, prev, close = bars_of(np.random.default_rng(3), 5000)
    assert len(ratchet.follow(upper, prev, close, range(5000)).start) == 1
    rising = [float(i) for i in range(3000)]
    assert len(ratchet.follow([x + 1e6 for x in rising], [x - 1 for x in rising], rising, range(3000)).start) <= 3003

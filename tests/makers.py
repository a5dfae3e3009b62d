"""Deterministic series for the tests."""
from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd

BAR_SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


def walk(symbol: str, n: int, seed: int, start: str = "2010-01-04", step: float = 0.02) -> pd.DataFrame:
    """A random walk with gaps, whole cents and whole volumes."""
    rng = np.random.default_rng(seed)
    close = np.round(100 * np.exp(np.cumsum(rng.normal(0.0004, step, n))), 2)
    opened = np.round(np.concatenate([[close[0]], close[:-1]]) * np.exp(rng.normal(0, step, n)), 2)
    high = np.round(np.maximum(opened, close) * (1 + rng.random(n) * 0.01), 2)
    low = np.round(np.minimum(opened, close) * (1 - rng.random(n) * 0.01), 2)
    volume = np.floor(rng.exponential(1000, n)) + 1
    return pd.DataFrame({
        "symbol": symbol, "ts": pd.date_range(start, periods=n, freq="D"), "open": opened, "high": high, "low": low,
        "close": close, "volume": volume,
    })


def frame(spark, pdf: pd.DataFrame):
    return spark.createDataFrame(pdf, schema=BAR_SCHEMA)


def flat(symbol: str, closes, volumes=None, spread: float = 0.5, start: str = "2020-01-01") -> pd.DataFrame:
    """Bars around given closes: open is the previous close, high and low a spread away."""
    c = np.asarray(closes, dtype=float)
    o = np.concatenate([[c[0]], c[:-1]])
    return pd.DataFrame({
        "symbol": symbol, "ts": [dt.datetime.fromisoformat(start) + dt.timedelta(days=i) for i in range(len(c))],
        "open": o, "high": np.maximum(o, c) + spread, "low": np.minimum(o, c) - spread, "close": c,
        "volume": np.full(len(c), 1000.0) if volumes is None else np.asarray(volumes, dtype=float),
    })

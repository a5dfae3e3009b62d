"""Indicators of bars that arrive as a stream, kept up to date per symbol.

The state of a symbol is what the next bar needs: how many bars there were, the last closes, volumes and ranges of the longest spans,
and the exponential means. It has a fixed size, so a new bar costs one update whatever came before. Bars wait in the state until the
watermark passes them, so that late and corrected bars take their place in time; of versions of one time the last sent counts. Bars
that come after the watermark has passed them are dropped. Results equal ``indicators.all_indicators`` over the same bars,
however they are split into batches.

Needs the RocksDB state store (``use_state_store``).
"""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidebars.operators.indicators import EMA_SPANS, RANGE_SPAN, SMA_SPANS, VOLUME_SPAN
from tidebars.streaming.event_time import valid

INDICATORS = (*(f"sma{n}" for n in SMA_SPANS), *(f"ema{n}" for n in EMA_SPANS), f"avg_vol_{VOLUME_SPAN}", "rel_vol",
              f"adr_pct_{RANGE_SPAN}", f"atr_{RANGE_SPAN}")
OUTPUT = "symbol string, ts timestamp, rn bigint, close double, " + ", ".join(f"{c} double" for c in INDICATORS)
STATE = ("rn bigint, last_us bigint, emas array<double>, closes array<double>, volumes array<double>, range_pct array<double>, "
         "true_range array<double>")
WAITING = "seq binary, high double, low double, close double, volume double"


class Carry(NamedTuple):
    """What a symbol's next bar needs. Arrays end with the latest bar and hold one value less than their longest span."""
    rn: int
    last_us: int
    emas: list[float]
    closes: list[float]
    volumes: list[float]
    range_pct: list[float]
    true_range: list[float]


START = Carry(0, -(1 << 62), [], [], [], [], [])


def _means(held: np.ndarray, new: int, span: int) -> np.ndarray:
    """Mean of the last ``span`` values at each of the ``new`` last places, NaN before there are so many."""
    return pd.Series(held).rolling(span).mean().to_numpy()[len(held) - new:]


def advance(carry: Carry, us: np.ndarray, high: np.ndarray, low: np.ndarray, close: np.ndarray,
            volume: np.ndarray) -> tuple[Carry, dict[str, np.ndarray]]:
    """The state after new bars in order of time, and the indicators of each."""
    n = len(close)
    closes, volumes = np.concatenate((carry.closes, close)), np.concatenate((carry.volumes, volume))
    previous = np.concatenate((carry.closes[-1:] or [np.nan], close[:-1]))
    ranges = np.fmax(high - low, np.fmax(np.abs(high - previous), np.abs(low - previous)))
    true_range = np.concatenate((carry.true_range, ranges))
    range_pct = np.concatenate((carry.range_pct, (high - low) / close * 100.0))
    out: dict[str, np.ndarray] = {f"sma{span}": _means(closes, n, span) for span in SMA_SPANS}
    emas = []
    for i, span in enumerate(EMA_SPANS):
        seed = carry.emas[i:i + 1]
        line = pd.Series(np.concatenate((seed, close))).ewm(span=span, adjust=False).mean().to_numpy()[len(seed):]
        out[f"ema{span}"] = line
        emas.append(float(line[-1]))
    base = out[f"avg_vol_{VOLUME_SPAN}"] = _means(volumes, n, VOLUME_SPAN)
    out["rel_vol"] = np.divide(volume, base, out=np.full(n, np.nan), where=base != 0)
    out[f"adr_pct_{RANGE_SPAN}"] = _means(range_pct, n, RANGE_SPAN)
    out[f"atr_{RANGE_SPAN}"] = _means(true_range, n, RANGE_SPAN)
    out["rn"] = np.arange(carry.rn + 1, carry.rn + n + 1)

    def tail(x: np.ndarray, span: int) -> list[float]:
        return x[-(span - 1):].tolist()

    return Carry(carry.rn + n, int(us[-1]), emas, tail(closes, max(SMA_SPANS)), tail(volumes, VOLUME_SPAN), tail(range_pct, RANGE_SPAN),
                 tail(true_range, RANGE_SPAN)), out


class Indicators(StatefulProcessor):
    """Bars of one symbol: those behind the watermark are worked off in order, the others wait."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carry = handle.getValueState("carry", STATE)
        self.waiting = handle.getMapState("waiting", "us bigint", WAITING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.carry.get() if self.carry.exists() else START
        last_us, mark = held[1], timerValues.getCurrentWatermarkInMs() * 1000
        new = pd.concat(list(rows))
        new = new[new.us > last_us].sort_values(["us", "seq"], kind="stable").drop_duplicates("us", keep="last")
        for us, *bar in new[["us", "seq", "high", "low", "close", "volume"]].itertuples(index=False, name=None):
            before = self.waiting.getValue((us,)) if self.waiting.containsKey((us,)) else None
            if before is None or bytes(before[0]) <= bytes(bar[0]):
                self.waiting.updateValue((us,), tuple(bar))
        yield from self._work_off(key, mark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._work_off(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass

    def _work_off(self, key, mark: int) -> Iterator[pd.DataFrame]:
        times = sorted(k[0] for k in self.waiting.keys())
        ready = [us for us in times if us <= mark]
        if len(ready) < len(times):     # wake up when the watermark reaches the next one, if nothing comes before
            self.handle.registerTimer(-(-times[len(ready)] // 1000))
        if not ready:
            return
        bars = []
        for us in ready:
            bars.append(self.waiting.getValue((us,))[1:])
            self.waiting.removeKey((us,))
        held = Carry(*self.carry.get()) if self.carry.exists() else START
        held = held._replace(**{c: list(getattr(held, c)) for c in Carry._fields[2:]})
        high, low, close, volume = np.array(bars, dtype=float).T
        carry, out = advance(held, np.array(ready), high, low, close, volume)
        self.carry.update(tuple(carry))
        yield pd.DataFrame({"symbol": key[0], "ts": pd.to_datetime(ready, unit="us"), "rn": out["rn"], "close": close,
                            **{c: out[c] for c in INDICATORS}})


def use_state_store(spark: SparkSession) -> None:
    """The state store that stateful processors need, for streams that are started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def live_indicators(feed: DataFrame, delay: str) -> DataFrame:
    """Indicators of every bar that the watermark has passed, as a stream. ``feed`` has ``seq``, see ``extend.read_feed``."""
    seq = F.concat(F.lpad(F.hex(F.unix_micros("seq.file_modification_time")), 16, "0"), F.col("seq.file_path"), F.lpad(F.hex("seq.row_index"), 16, "0"))
    bars = valid(feed).withWatermark("ts", delay).select(
        "symbol", "ts", F.unix_micros("ts").alias("us"), seq.cast("binary").alias("seq"), "high", "low", "close", "volume")
    return bars.groupBy("symbol").transformWithStateInPandas(Indicators(), OUTPUT, "append", "eventTime")

"""Trend bands, and bands whose width factor is chosen at each bar by clustering.

Definition. For a factor f the basic bands are (high+low)/2 plus and minus f times the mean
true range. The upper band only falls and the lower only rises, until the close before crosses
it. The trend is up when the close is above the upper band, down below the lower, else as
before. A factor performs by the exponential mean of (trend before times change of the close), so recent bars weigh most. At each
bar the performances so far, in steps of ``TICK``, are cut into three clusters with the largest spread between them; the mean factor of
the best cluster is the factor of that bar. Later bars change nothing before them.

The bands are a true recursion, so a chunk needs the state at the end of the chunk before it. A first pass turns each chunk into a
function of that state (``functions.ratchet``: mostly one constant), one row per chunk and factor; these are walked in order, chunk
after chunk; a second pass runs the bars from the right states. That is two passes whatever the trend does, and a symbol of
one chunk needs the second only.
"""
from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.functions import ratchet, rolling
from tidebars.series import CHUNK, back, core, with_halo
from tidebars.session import stage

FACTORS = tuple(1.0 + 0.5 * i for i in range(9))
MEMORY = 10
CLUSTERS = 3
TICK = 1e-6
KEY = ["symbol", "chunk"]
SUMMARY = ("symbol string, chunk bigint, i int, first array<double>, upper_start array<double>, upper_value array<double>, upper_at array<bigint>, "
           "lower_start array<double>, lower_value array<double>, lower_at array<bigint>")
STARTS = "symbol string, chunk bigint, i int, state array<double>"
BANDS = ("symbol string, chunk bigint, rn bigint, ts timestamp, close double, prev_close double, middle double, width double, "
         "factors array<double>, trend array<int>, line array<double>")
_NO_BANDS = {c: [] for c in ("symbol", "chunk", "rn", "ts", "close", "prev_close", "middle", "width", "factors", "trend", "line")}


def _banded(bars: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Bars with a width, in order, and their edges: arrays of bars by factors."""
    bars = bars.sort_values("rn")
    bars = bars[bars["width"].notna()]
    if not len(bars):
        return bars, np.empty((0, 0)), np.empty((0, 0))
    reach = np.vstack(bars["factors"].to_numpy()) * bars["width"].to_numpy()[:, None]
    middle = bars["middle"].to_numpy()[:, None]
    return bars, middle + reach, middle - reach


def chunk_functions(bars: pd.DataFrame) -> pd.DataFrame:
    """One row per factor: the first bar of the chunk that has bands, and what the others do to the state after it."""
    symbol, chunk, n_factors = bars["symbol"].iloc[0], bars["chunk"].iloc[0], len(bars["factors"].iloc[0])
    bars, upper, lower = _banded(bars)
    prev, close, rn = (bars[c].to_numpy(dtype=float) for c in ("prev_close", "close", "rn"))
    out = []
    for i in range(n_factors):
        if not len(bars):
            out.append((symbol, chunk, i, *[[]] * 7))
            continue
        numbers = rn[1:].astype(int).tolist()
        up = ratchet.follow(upper[1:, i].tolist(), prev[1:].tolist(), close[1:].tolist(), numbers)
        down = ratchet.follow((-lower[1:, i]).tolist(), (-prev[1:]).tolist(), (-close[1:]).tolist(), numbers)
        out.append((symbol, chunk, i, [upper[0, i], lower[0, i], prev[0], close[0]], *up, *down))
    return pd.DataFrame(out, columns=[part.split()[0] for part in SUMMARY.split(", ")])


def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """States at the start of chunks, from functions in the order of symbol, factor and chunk; one state is held at a time."""
    at, state = None, None
    for batch in batches:
        out = []
        for symbol, chunk, i, first, *parts in batch.itertuples(index=False, name=None):
            if (symbol, i) != at:
                at, state = (symbol, i), None
            if len(first):
                state = ratchet.first_state(*first[:2]) if state is None else ratchet.step(state, *first)
                state = ratchet.end_state(state, ratchet.Pieces(*parts[:3]), ratchet.Pieces(*parts[3:]))
            if state is not None:
                out.append((symbol, chunk + 1, i, [*map(float, state)]))
        yield pd.DataFrame(out, columns=["symbol", "chunk", "i", "state"])


def start_states(inputs: DataFrame) -> DataFrame:
    """Rows (symbol, chunk, states): upper, lower and trend of each factor where a chunk starts; none for a series' first bands."""
    last = inputs.groupBy("symbol").agg(F.max("chunk").alias("last"))
    ahead = inputs.join(last, "symbol").where("chunk < last").drop("last")
    functions = ahead.groupBy(*KEY).applyInPandas(chunk_functions, SUMMARY)
    ordered = functions.repartition("symbol", "i").sortWithinPartitions("symbol", "i", "chunk")
    starts = ordered.mapInPandas(walk, STARTS)
    return starts.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "state"))), lambda x: x["state"]).alias("states"))


def chunk_bands(key, bars: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
    """One row per bar: trend and the band that is in force, per factor."""
    bars, upper, lower = _banded(bars) if len(bars) else (bars, None, None)
    if not len(bars):
        return pd.DataFrame(_NO_BANDS, dtype=object)
    prev, close = bars["prev_close"].tolist(), bars["close"].tolist()
    trends, lines = [], []
    for i in range(upper.shape[1]):
        state = None
        if len(start):
            u, low, trend = start["states"].iloc[0][i]
            state = u, low, int(trend)
        found = ratchet.states(state, zip(upper[:, i].tolist(), lower[:, i].tolist(), prev, close))
        trends.append([t for _, _, t in found])
        lines.append([low if t > 0 else u for u, low, t in found])
    return pd.DataFrame({
        "symbol": key[0], "chunk": key[1], **{c: bars[c].to_numpy() for c in ("rn", "ts", "close", "prev_close", "middle", "width", "factors")},
        "trend": list(np.array(trends, dtype=np.int32).T), "line": list(np.array(lines).T),
    })


def band_inputs(frame: DataFrame, factors: str) -> DataFrame:
    """What the recursion reads; ``frame`` carries ``atr_20`` and ``prev_close``."""
    return frame.selectExpr("symbol", "chunk", "rn", "ts", "close", "prev_close", "(high + low) / 2D AS middle",
                            "atr_20 AS width", f"{factors} AS factors")


def run_bands(inputs: DataFrame) -> DataFrame:
    """``inputs`` is read twice: stage it first when it is expensive."""
    starts = start_states(inputs)
    return inputs.groupBy(*KEY).cogroup(starts.groupBy(*KEY)).applyInPandas(chunk_bands, BANDS)


def trend_bands(frame: DataFrame, factors: Sequence[float] = FACTORS) -> DataFrame:
    """Trend (1 or -1) and band in force per bar, as arrays in the order of ``factors``."""
    return run_bands(band_inputs(frame, f"array({', '.join(f'{f!r}D' for f in factors)})"))


def performance(bands: DataFrame, n_factors: int, memory: int = MEMORY, chunk_rows: int = CHUNK) -> DataFrame:
    """Performance of each factor as of each bar, added to ``bands`` as an array."""
    # bars before the first band do not count: number the banded bars from 1
    first = bands.groupBy("symbol").agg(F.min("rn").alias("rn_first"))
    numbered = bands.join(first, "symbol").withColumns({"home_rn": F.col("rn"), "home": F.col("chunk")}).withColumn(
        "rn", F.col("rn") - F.col("rn_first") + 1).withColumn("chunk", F.floor((F.col("rn") - 1) / F.lit(chunk_rows)).cast("bigint"))
    df = with_halo(numbered, before=rolling.ema_halo([memory]) + 1, chunk_rows=chunk_rows)
    moved = {f"_x{i}": f"coalesce({back(f'trend[{i}]')} * (close - {back('close')}), 0D)" for i in range(n_factors)}
    means = rolling.exponential_means({f"_p{i}": (f"_x{i}", memory) for i in range(n_factors)})
    packed = {"performance": f"array({', '.join(f'_p{i}' for i in range(n_factors))})"}
    done = core(rolling.apply(df, [moved, {}, {}, {}, packed], rolling.later(means)))
    return done.withColumns({"rn": F.col("home_rn"), "chunk": F.col("home")}).select(*bands.columns, "performance")


def best_factors(performances: np.ndarray, factors: Sequence[float]) -> np.ndarray:
    """Per row of performances: the mean factor of the best of three clusters.

    In order of performance (of equal ones by factor) the clusters are runs; those with the largest sum of squares between
    them count, of equal sums the first in order of their cuts.
    """
    p, f = np.round(performances / TICK), np.asarray(factors, dtype=float)
    order = np.argsort(p, axis=1, kind="stable")
    sums = np.pad(np.cumsum(np.take_along_axis(p, order, 1), axis=1), ((0, 0), (1, 0)))
    n = p.shape[1]
    cuts = [(0, *c, n) for c in itertools.combinations(range(1, n), min(CLUSTERS, n) - 1)]
    spread = np.zeros((len(p), len(cuts)))
    for k, cut in enumerate(cuts):
        for a, b in zip(cut, cut[1:]):
            spread[:, k] += (sums[:, b] - sums[:, a]) ** 2 / (b - a)
    top = np.array([cut[-2] for cut in cuts])[spread.argmax(1)]
    inside = np.arange(n) >= top[:, None]
    return (f[order] * inside).sum(1) / inside.sum(1)


def chosen_factors(performances: DataFrame, factors: Sequence[float] = FACTORS) -> DataFrame:
    """Adds ``factor``, from the performances of each bar alone."""
    @F.pandas_udf("double")
    def choose(found: pd.Series) -> pd.Series:
        return pd.Series(best_factors(np.vstack(found.to_numpy()), factors) if len(found) else [], dtype=float)
    return performances.withColumn("factor", choose("performance"))


def adaptive_bands(frame: DataFrame, factors: Sequence[float] = FACTORS, memory: int = MEMORY,
                   chunk_rows: int = CHUNK) -> DataFrame:
    """Trend and band per bar, each bar's edges with the factor chosen at that bar."""
    tried = stage(trend_bands(frame, factors), "bands")
    chosen = stage(chosen_factors(performance(tried, len(factors), memory, chunk_rows), factors).select(
        "symbol", "chunk", "rn", "ts", "close", "prev_close", "middle", "width", "factor"), "factors")
    own = run_bands(chosen.withColumn("factors", F.array("factor")).drop("factor"))
    return own.select("symbol", "chunk", "rn", "ts", *(F.get(c, F.lit(0)).alias(name) for c, name in (
        ("factors", "factor"), ("trend", "trend"), ("line", "line"))))

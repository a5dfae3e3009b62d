"""Time series laid out so that no symbol has to fit in one task.

``index_series`` numbers the bars of each symbol (``rn``, from 1, dense) and cuts
them into chunks of ``CHUNK`` consecutive bars. Everything later works on
(symbol, chunk):

* bounded frames (rolling means, lags, swing tests) read a *halo* of rows copied
  from the neighbouring chunks (``with_halo``), so the window partition is at
  most ``CHUNK`` plus the halo, however long the symbol is;
* unbounded frames (running maximum, running count) are two-level scans
  (``running``): one row per chunk is scanned across chunks and joined back;
* windows of a move are equi-joins on (symbol, chunk) plus a range on ``rn``
  (``locate_moves`` and ``move_bars``).

A symbol with fewer than ``CHUNK`` bars, the usual case for daily data, is a
single chunk and pays for none of this.
"""
from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 8192
DAY_SECONDS = 86400
MOVE_KEY = ("symbol", "year")


def chunk_of(rn: Column | str, chunk_rows: int = CHUNK) -> Column:
    """Chunk number of a row number."""
    rn = F.col(rn) if isinstance(rn, str) else rn
    return F.floor((rn - 1) / F.lit(chunk_rows)).cast("bigint")


def mean_step(bars: DataFrame) -> float:
    """Mean seconds between the bars of the symbol that has them closest together (a day if there are none)."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    per_symbol = bars.groupBy("symbol").agg(((F.max(seconds) - F.min(seconds)) / F.count(F.lit(1))).alias("step"))
    step = per_symbol.agg(F.min(F.when(F.col("step") > 0, F.col("step")))).first()[0]
    return step or float(DAY_SECONDS)


def index_series(bars: DataFrame, bar_seconds: float | None = None, chunk_rows: int = CHUNK) -> DataFrame:
    """Add ``rn`` and ``chunk``; expects one bar per (symbol, ts), or ``seq`` to order bars of one time.

    Rows are numbered inside time tiles that can hold at most about ``chunk_rows``
    bars; the offsets of the tiles come from a running sum over tile counts. Without ``bar_seconds`` the width of a tile
    comes from the densest symbol: its mean distance between bars.
    """
    if bar_seconds is None:
        bar_seconds = mean_step(bars)
    tile = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / F.lit(bar_seconds * chunk_rows))
    tiled = bars.withColumn("tile", tile)
    across = Window.partitionBy("symbol").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tiled.groupBy("symbol", "tile")
        .agg(F.count(F.lit(1)).alias("tile_rows"))
        .select("symbol", "tile", F.coalesce(F.sum("tile_rows").over(across), F.lit(0)).alias("tile_offset"))
    )
    inside = Window.partitionBy("symbol", "tile").orderBy("ts", *(["seq"] if "seq" in bars.columns else []))
    return (
        tiled.join(offsets, ["symbol", "tile"])
        .withColumn("rn", F.col("tile_offset") + F.row_number().over(inside))
        .withColumn("chunk", chunk_of("rn", chunk_rows))
        .drop("tile", "tile_offset")
    )


def with_halo(indexed: DataFrame, before: int = 0, after: int = 0, chunk_rows: int = CHUNK) -> DataFrame:
    """Copy the edge rows of each chunk into its neighbours.

    Adds ``is_core``: true for a row in its own chunk. Windows over a chunk
    (``rows``, ``back``) then see ``before`` rows ahead of every core row and
    ``after`` rows behind it; drop the copies with ``core``. Bars that have their halo (``sources.layout``) stay as they are.
    """
    if "is_core" in indexed.columns:
        return indexed
    slot = f"pmod(rn - 1, {chunk_rows})"
    # a wide halo reaches over several chunks
    ahead = [f"CASE WHEN {slot} >= {j * chunk_rows - before} THEN chunk + {j} END" for j in range(1, -(-before // chunk_rows) + 1)]
    behind = [f"CASE WHEN {slot} < {after - (j - 1) * chunk_rows} AND chunk >= {j} THEN chunk - {j} END" for j in range(1, -(-after // chunk_rows) + 1)]
    targets = f"array_compact(array({', '.join(['chunk', *ahead, *behind])}))"
    kept = [c for c in indexed.columns if c != "chunk"]
    copied = indexed.selectExpr(*kept, "chunk AS home_chunk", f"explode({targets}) AS chunk")
    return copied.selectExpr(*kept, "chunk", "home_chunk = chunk AS is_core")


def core(df: DataFrame) -> DataFrame:
    """Keep each row once, in its own chunk."""
    return df.filter("is_core").drop("is_core")


# the window of a chunk with its halo, for SQL expressions
IN_CHUNK = "PARTITION BY symbol, chunk ORDER BY rn"


def rows(before: int | str, after: int | str = 0) -> str:
    """``OVER (...)`` clause for the rows from ``before`` to ``after`` around the current one.

    Negative numbers lie before it; "first" is the start of the chunk with its halo.
    """
    def bound(n: int | str) -> str:
        if n == "first":
            return "UNBOUNDED PRECEDING"
        return "CURRENT ROW" if n == 0 else f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}"
    return f"OVER ({IN_CHUNK} ROWS BETWEEN {bound(before)} AND {bound(after)})"


def back(column: str, n: int = 1) -> str:
    """Value ``n`` bars earlier."""
    return f"lag({column}, {n}) OVER ({IN_CHUNK})"


class Running(NamedTuple):
    """One running value: ``fn`` is sum, max, min or last (skips nulls)."""

    out: str
    fn: str
    value: Column
    exclusive: bool = False


def running(df: DataFrame, keys: Sequence[str], specs: Sequence[Running], order: str = "rn",
            tile: str = "chunk") -> DataFrame:
    """Running values per ``keys`` in ``order``, as a scan over tiles.

    ``tile`` must not decrease along ``order``. ``df`` is read twice, so stage it
    first when it is expensive.
    """
    keys = list(keys)
    totals, carries = [], []
    across = Window.partitionBy(*keys).orderBy(tile).rowsBetween(Window.unboundedPreceding, -1)
    for s in specs:
        part = f"part_{s.out}"
        if s.fn == "sum":
            totals.append(F.sum(s.value).alias(part))
            carries.append(F.sum(part).over(across).alias(f"carry_{s.out}"))
        elif s.fn == "max":
            totals.append(F.max(s.value).alias(part))
            carries.append(F.max(part).over(across).alias(f"carry_{s.out}"))
        elif s.fn == "min":
            totals.append(F.min(s.value).alias(part))
            carries.append(F.min(part).over(across).alias(f"carry_{s.out}"))
        elif s.fn == "last":
            keyed = F.when(s.value.isNotNull(), F.struct(F.col(order).alias("o"), s.value.alias("v")))
            totals.append(F.max(keyed).getField("v").alias(part))
            carries.append(F.last(part, ignorenulls=True).over(across).alias(f"carry_{s.out}"))
        else:
            raise ValueError(f"unknown running function {s.fn}")
    carry = df.groupBy(*keys, tile).agg(*totals).select(*keys, tile, *carries)
    out = df.join(carry, [*keys, tile])
    base = Window.partitionBy(*keys, tile).orderBy(order)
    for s in specs:
        inside = base.rowsBetween(Window.unboundedPreceding, -1 if s.exclusive else 0)
        held = F.col(f"carry_{s.out}")
        if s.fn == "sum":
            value = F.coalesce(held, F.lit(0)) + F.coalesce(F.sum(s.value).over(inside), F.lit(0))
        elif s.fn == "max":
            value = F.greatest(held, F.max(s.value).over(inside))
        elif s.fn == "min":
            value = F.least(held, F.min(s.value).over(inside))
        else:
            value = F.coalesce(F.last(s.value, ignorenulls=True).over(inside), held)
        out = out.withColumn(s.out, value)
    return out.drop(*[f"carry_{s.out}" for s in specs])


def chunk_bounds(indexed: DataFrame) -> DataFrame:
    """First and last time of every chunk: one row per chunk."""
    return indexed.groupBy("symbol", "chunk").agg(F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))


def locate_moves(moves: DataFrame, indexed: DataFrame, key: Sequence[str] = MOVE_KEY, low: str = "low_date",
                 high: str = "high_date", chunk_rows: int = CHUNK) -> DataFrame:
    """Turn move dates into row numbers: adds ``rn_lo``, ``rn_hi``, ``n_bars``.

    A move whose window holds no bar keeps nulls. Only the chunks at the two ends
    of a move are read.
    """
    key = list(key)
    ends = (
        moves.select(*key, F.col(low).alias("_low"), F.col(high).alias("_high"))
        .join(chunk_bounds(indexed), "symbol")
        .filter((F.col("max_ts") >= F.col("_low")) & (F.col("min_ts") <= F.col("_high")))
        .groupBy(*key, "_low", "_high")
        .agg(F.min("chunk").alias("c_lo"), F.max("chunk").alias("c_hi"))
        .withColumn("chunk", F.explode(F.array_distinct(F.array("c_lo", "c_hi"))))
    )
    rows = (
        ends.join(indexed.select("symbol", "chunk", "rn", "ts"), ["symbol", "chunk"])
        .filter(F.col("ts").between(F.col("_low"), F.col("_high")))
        .groupBy(*key)
        .agg(F.min("rn").alias("rn_lo"), F.max("rn").alias("rn_hi"))
    )
    return moves.join(rows, key, "left").withColumn("n_bars", F.col("rn_hi") - F.col("rn_lo") + 1)


def bars_at(df: DataFrame, indexed: DataFrame, rows: dict[str, str], columns: Sequence[str],
            key: Sequence[str] = MOVE_KEY, chunk_rows: int = CHUNK) -> DataFrame:
    """Look up bars by row number: adds ``<tag>_<column>`` for each ``{tag: rn column}``."""
    key = list(key)
    rest = [c for c in df.columns if c not in key]
    picks = F.array(*[F.struct(F.lit(t).alias("tag"), F.col(c).alias("rn")) for t, c in rows.items()])
    wanted = (
        df.select(*key, F.struct(*rest).alias("_row"), F.explode(picks).alias("p"))
        .select(*key, "_row", "p.tag", "p.rn")
        .withColumn("chunk", chunk_of("rn", chunk_rows))
    )
    # a left join: a move without row numbers keeps its row
    found = wanted.join(indexed.select("symbol", "chunk", "rn", *columns), ["symbol", "chunk", "rn"], "left")
    values = [
        F.max(F.when(F.col("tag") == t, F.col(c))).alias(f"{t}_{c}") for t in rows for c in columns
    ]
    looked_up = found.groupBy(*key).agg(F.first("_row").alias("_row"), *values)
    return looked_up.select(*key, "_row.*", *[f"{t}_{c}" for t in rows for c in columns])


def span_bars(spans: DataFrame, indexed: DataFrame, rn_from: str, rn_to: str, chunk_rows: int = CHUNK) -> DataFrame:
    """Bars with ``rn`` between two columns of ``spans``, as an equi-join on (symbol, chunk)."""
    chunks = F.sequence(chunk_of(rn_from, chunk_rows), chunk_of(rn_to, chunk_rows))
    return (
        spans.filter(F.col(rn_from) <= F.col(rn_to))
        .withColumn("chunk", F.explode(chunks))
        .join(indexed, ["symbol", "chunk"])
        .filter(F.col("rn").between(F.col(rn_from), F.col(rn_to)))
    )


def move_bars(located: DataFrame, indexed: DataFrame, chunk_rows: int = CHUNK) -> DataFrame:
    """Bars of each move with ``pos``, the 0-based position inside the move."""
    spans = located.select(*MOVE_KEY, "rn_lo", "rn_hi", "n_bars")
    return span_bars(spans, indexed, "rn_lo", "rn_hi", chunk_rows).withColumn("pos", F.col("rn") - F.col("rn_lo"))

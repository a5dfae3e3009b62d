"""Best moves of any ranges of bars, from one summary per chunk.

The summary of a run of bars is its earliest lowest close, its earliest highest close before any at or below zero, its best move, and
its volume. Summaries of
neighbouring runs merge: the best move of both is the better of their own moves and the one from the left low to the right
high. So a range of bars is put together from the summaries of the chunks inside it and the bars of the two chunks at its ends:
ranges may be long, many, and overlap, and what moves is their ends and one row per chunk between.
Results are those of ``best_moves.best_moves`` over the bars of the range.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.series import CHUNK, chunk_of, locate_moves

PARTS = ("low", "high", "best", "volume", "n_volumes")


def _gain(high: Column, low: Column) -> Column:
    """A move as a struct that is larger when it is better: larger gain, earlier high. Null if the low is not above zero."""
    gain = F.when(low["close"] > 0, (F.try_divide(high["close"], low["close"]) - 1) * 100.0)
    return F.when(gain.isNotNull(), F.struct(gain.alias("gain_pct"), (-high["rn"]).alias("o"), low.alias("low"), high.alias("high")))


def summarize(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """One summary per ``by``, whose rows are neighbours. Parts that no close gives are null."""
    known = F.when(F.col("close").isNotNull(), F.struct("close", "rn", "ts"))
    upto = Window.partitionBy(*by).orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(*by, "volume", known.alias("bar"), F.min(known).over(upto).alias("floor"))
    # of the highest closes the earliest: the largest (close, -rn); a low at or below zero ends the gains of everything after it
    top = F.max(F.when(F.col("bar").isNotNull() & (F.col("floor.close") > 0), F.struct(F.col("bar.close").alias("close"), (-F.col("bar.rn")).alias("o"), F.col("bar.ts").alias("ts"))))
    return rows.groupBy(*by).agg(
        F.min("bar").alias("low"), top.alias("top"), F.max(_gain(F.col("bar"), F.col("floor"))).alias("best"),
        F.sum("volume").alias("volume"), F.count("volume").alias("n_volumes"),
    ).select(*by, "low", F.when(F.col("top").isNotNull(), F.struct("top.close", (-F.col("top.o")).alias("rn"), "top.ts")).alias("high"),
             "best", "volume", "n_volumes")


def chunk_summaries(indexed: DataFrame) -> DataFrame:
    """The summaries of all chunks; write them once and keep them with the bars."""
    return summarize(indexed.select("symbol", "chunk", "rn", "ts", "close", "volume"), ["symbol", "chunk"])


def merge(pieces: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Summary per ``by`` of pieces that follow each other in ``order``."""
    ahead = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    floor = F.min("low").over(ahead)
    cut = pieces.withColumn("floor", floor)
    open_ = F.col("floor").isNull() | (F.col("floor.close") > 0)
    across = F.when(F.col("floor").isNotNull(), _gain(F.col("high"), F.col("floor")))
    own = F.when(open_, F.greatest("best", across))
    return cut.groupBy(*by).agg(F.max(own).alias("best"), F.sum("volume").alias("volume"), F.sum("n_volumes").alias("n_volumes"))


def pieces_of(located: DataFrame, indexed: DataFrame, summaries: DataFrame, key: Sequence[str], chunk_rows: int = CHUNK) -> DataFrame:
    """What the ranges are put together from: summaries of their end chunks' bars, and of the chunks between."""
    spans = located.filter(F.col("rn_lo").isNotNull()).select(
        *key, "rn_lo", "rn_hi", chunk_of("rn_lo", chunk_rows).alias("c_lo"), chunk_of("rn_hi", chunk_rows).alias("c_hi"))
    ends = spans.withColumn("chunk", F.explode(F.array_distinct(F.array("c_lo", "c_hi"))))
    bars = ends.join(indexed.select("symbol", "chunk", "rn", "ts", "close", "volume"), ["symbol", "chunk"]).filter(
        F.col("rn").between(F.col("rn_lo"), F.col("rn_hi")))
    between = spans.filter(F.col("c_hi") > F.col("c_lo") + 1).withColumn("chunk", F.explode(F.sequence(F.col("c_lo") + 1, F.col("c_hi") - 1)))
    inner = between.select(*key, "chunk").join(summaries, ["symbol", "chunk"]).select(*key, "chunk", *PARTS)
    return summarize(bars, [*key, "chunk"]).unionByName(inner)


def best_in(spans: DataFrame, indexed: DataFrame, summaries: DataFrame, key: Sequence[str] = ("symbol", "year"), low: str = "from_ts",
            high: str = "to_ts", chunk_rows: int = CHUNK) -> DataFrame:
    """Best move of each span (``key``, with the symbol in it, and its first and last time, both inside); spans without a gain are left out."""
    key = list(key)
    located = locate_moves(spans.select(*key, low, high), indexed, key=key, low=low, high=high, chunk_rows=chunk_rows)
    merged = merge(pieces_of(located, indexed, summaries, key, chunk_rows), key, "chunk")
    return merged.filter(F.col("best.gain_pct") > 0).select(
        *key, F.col("best.gain_pct").alias("gain_pct"), F.col("best.low.ts").alias("low_date"), F.col("best.high.ts").alias("high_date"),
        F.col("best.low.close").alias("low_price"), F.col("best.high.close").alias("high_price"),
        (F.try_divide("volume", "n_volumes") / 1e9).alias("avg_vol_b"))


def year_bounds(year: Column) -> tuple[Column, Column]:
    """First and last time of a calendar year."""
    first = F.make_date(year, F.lit(1), F.lit(1)).cast("timestamp")
    return first, F.make_date(year + 1, F.lit(1), F.lit(1)).cast("timestamp") - F.expr("INTERVAL 1 MICROSECOND")


def best_of_periods(asked: DataFrame, indexed: DataFrame, summaries: DataFrame, bounds: Callable[[Column], tuple[Column, Column]] = year_bounds,
                    chunk_rows: int = CHUNK) -> DataFrame:
    """Best move of each asked (symbol, year); reads the chunks at the ends of the periods, whatever lies between."""
    first, last = bounds(F.col("year"))
    spans = asked.select("symbol", "year", first.alias("from_ts"), last.alias("to_ts"))
    return best_in(spans, indexed, summaries, chunk_rows=chunk_rows)

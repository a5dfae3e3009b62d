"""Rolling, recursive and benchmark-relative indicators."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebars.functions import rolling
from tidebars.series import CHUNK, back, bars_at, core, locate_moves, rows, with_halo

SMA_SPANS = (50, 150, 200)
EMA_SPANS = (10, 20)
VOLUME_SPAN = 50
RANGE_SPAN = 20
STRENGTH_SPAN = 63
HIGH_STEPS = (12, 84, 252)   # the 252-bar high, put together from shorter ones
PRIOR_SPAN = 63
POLE_LENGTHS = (20, 30, 40)
DOWN_DAYS = 10
SLOPE_BACK = 21
FULL_HALO = max(HIGH_STEPS[-1], rolling.ema_halo(EMA_SPANS), max(SMA_SPANS) + SLOPE_BACK)    # the longest look back of all indicators
GAP_SCAN_SPAN = 20  # vol_mean_20 stays in the frame for the gap scan of a move
PUBLIC_COLUMNS = (
    "sma50", "sma150", "sma200", "ema10", "ema20",
    "avg_vol_50", "rel_vol", "adr_pct_20", "atr_20", "rel_strength_63",
)


def moving_averages(indexed: DataFrame, sma: Sequence[int] = SMA_SPANS, ema: Sequence[int] = EMA_SPANS,
                    chunk_rows: int = CHUNK) -> DataFrame:
    """Any set of simple and exponential means of the close: ``sma<n>`` and ``ema<n>``."""
    halo = max([*(n - 1 for n in sma), rolling.ema_halo(ema), 1])
    df = with_halo(indexed, before=halo, chunk_rows=chunk_rows)
    plans = [rolling.rolling_means({f"sma{n}": ("close", n) for n in sma})]
    if ema:
        plans.append(rolling.exponential_means({f"ema{n}": ("close", n) for n in ema}))
    return core(rolling.apply(df, *plans))


def volume_baseline(indexed: DataFrame, span: int = VOLUME_SPAN, chunk_rows: int = CHUNK) -> DataFrame:
    """Mean volume, and the bar's volume relative to it (the mean includes the bar)."""
    df = with_halo(indexed, before=span - 1, chunk_rows=chunk_rows)
    df = rolling.apply(df, rolling.rolling_means({f"avg_vol_{span}": ("volume", span)}))
    return rolling.add(core(df), {"rel_vol": f"try_divide(volume, avg_vol_{span})"})


RANGE_PCT = "try_divide(high - low, close) * 100D"
# the previous close is missing on the first bar; greatest skips nulls
TRUE_RANGE = f"greatest(high - low, abs(high - {back('close')}), abs(low - {back('close')}))"


def range_measures(indexed: DataFrame, span: int = RANGE_SPAN, chunk_rows: int = CHUNK) -> DataFrame:
    """Mean range in percent of the close, true range, and its plain mean."""
    df = with_halo(indexed, before=span, chunk_rows=chunk_rows)
    ranges = [{"_range_pct": RANGE_PCT, "true_range": TRUE_RANGE}]
    means = rolling.rolling_means({f"adr_pct_{span}": ("_range_pct", span), f"atr_{span}": ("true_range", span)})
    return core(rolling.apply(df, ranges, rolling.later(means)))


SLOT_SECONDS = 86400


def benchmark_slots(benchmark: DataFrame, slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """One row per slot of time from the benchmark's first to its last: its closes in that slot, and the last one before it.

    ``steps`` is the slot's (ts, close) in order, ``carry`` the close known when the slot begins. What is scanned in order is one narrow
    row per slot with a close, so its number is bounded by the calendar, not by the data.
    """
    known = benchmark.filter(F.col("close").isNotNull() & F.col("ts").isNotNull()).select("ts", "close", slot_of(slot_seconds).alias("slot"))
    ends = known.groupBy("slot").agg(F.max(F.struct("ts", "close")).getField("close").alias("close"))
    in_order = Window.partitionBy(F.lit(0)).orderBy("slot")
    ahead = ends.select("slot", "close", F.lag("close").over(in_order).alias("earlier"), F.coalesce(F.lead("slot").over(in_order) - 1, "slot").alias("until"))
    filled = ahead.withColumnRenamed("slot", "own").withColumn("slot", F.explode(F.sequence("own", "until")))
    filled = filled.select("slot", F.when(F.col("slot") == F.col("own"), F.col("earlier")).otherwise(F.col("close")).alias("carry"))
    steps = known.groupBy("slot").agg(F.array_sort(F.collect_list(F.struct("ts", "close"))).alias("steps"))
    return filled.join(steps, "slot", "left")


def slot_of(slot_seconds: int) -> Column:
    return F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / F.lit(slot_seconds))


def align_benchmark(indexed: DataFrame, benchmark: DataFrame, slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """Add ``bench_close``: the benchmark's last close at or before each bar.

    Bars join on their slot of time and pick among its closes; choose a slot in which the benchmark has few (an hour for
    minutes). Nothing runs until the result is asked for.
    """
    slots = benchmark_slots(benchmark, slot_seconds).withColumnRenamed("slot", "_slot")
    last = benchmark.filter("close is not null and ts is not null").agg(F.max(F.struct("ts", "close")).alias("x")).scalar()
    joined = indexed.join(slots, slot_of(slot_seconds) == F.col("_slot"), "left")
    own = F.try_element_at(F.filter("steps", lambda s: s["ts"] <= F.col("ts")), F.lit(-1))["close"]
    after = F.when(F.col("ts") >= last["ts"], last["close"])
    return joined.select(*indexed.columns, F.coalesce(own, F.col("carry"), after).alias("bench_close"))


def strength(span: int = STRENGTH_SPAN) -> str:
    own, other = f"try_divide(close, {back('close', span)})", f"try_divide(bench_close, {back('bench_close', span)})"
    return f"try_divide({own}, {other})"


def relative_strength(aligned: DataFrame, span: int = STRENGTH_SPAN, chunk_rows: int = CHUNK) -> DataFrame:
    """Return over ``span`` bars divided by the benchmark's over the same bars."""
    df = with_halo(aligned, before=span, chunk_rows=chunk_rows)
    return core(rolling.add(df, {f"rel_strength_{span}": strength(span)}))


def benchmark_overlay(aligned: DataFrame) -> DataFrame:
    """Symbol and benchmark rebased to 100 at the symbol's first bar that has a benchmark."""
    first = (
        aligned.filter(F.col("bench_close").isNotNull())
        .groupBy("symbol")
        .agg(F.min(F.struct("rn", "close", "bench_close")).alias("base"))
        .select("symbol", F.col("base.close").alias("base_close"), F.col("base.bench_close").alias("base_bench"))
    )
    return aligned.join(first, "symbol", "left").select(
        *aligned.columns,
        (F.try_divide("close", "base_close") * 100.0).alias("rebased"),
        (F.try_divide("bench_close", "base_bench") * 100.0).alias("bench_rebased"),
    )


def all_indicators(indexed: DataFrame, benchmark: DataFrame | None = None, chunk_rows: int = CHUNK) -> DataFrame:
    """The ten public indicators plus the lagged columns the detectors read.

    All frames share (symbol, chunk): one exchange, then windows over the same order; none over a table of ``sources.layout``.
    Bars that were aligned before have ``bench_close`` and need no benchmark.
    """
    source = align_benchmark(indexed, benchmark) if benchmark is not None else indexed
    df = with_halo(source, before=FULL_HALO, chunk_rows=chunk_rows)
    bar_columns = {
        "prev_close": back("close"), "_range_pct": RANGE_PCT, "true_range": TRUE_RANGE,
        "close_pos": "CASE WHEN high > low THEN (close - low) / (high - low) END",
        "prior_start_close": f"coalesce({back('close', PRIOR_SPAN)}, "
                             f"CASE WHEN rn <= {PRIOR_SPAN} THEN first(close) {rows('first')} END)",
        **{f"close_back_{n}": back("close", n) for n in POLE_LENGTHS},
        f"rel_strength_{STRENGTH_SPAN}": strength() if "bench_close" in source.columns else "CAST(NULL AS DOUBLE)",
    }
    down = f"(CASE WHEN close < prev_close THEN volume END) {rows(-DOWN_DAYS, -1)}"
    since_previous = {
        "gap_pct": "CASE WHEN prev_close > 0 THEN (open - prev_close) / prev_close END",
        "max_down_vol": f"max{down}", "n_down_days": f"count{down}",
    }
    from_means = {
        "rel_vol": f"try_divide(volume, avg_vol_{VOLUME_SPAN})",
        "sma50_back": back("sma50", SLOPE_BACK),
        **{f"vol_before_{n}": back(f"vol_mean_{n}") for n in POLE_LENGTHS},
    }
    df = rolling.apply(
        df, [bar_columns, since_previous, from_means],
        rolling.rolling_means({
            **{f"sma{n}": ("close", n) for n in SMA_SPANS},
            f"avg_vol_{VOLUME_SPAN}": ("volume", VOLUME_SPAN),
            **{f"vol_mean_{n}": ("volume", n) for n in POLE_LENGTHS},
        }),
        rolling.later(rolling.rolling_means({
            f"adr_pct_{RANGE_SPAN}": ("_range_pct", RANGE_SPAN), f"atr_{RANGE_SPAN}": ("true_range", RANGE_SPAN),
        })),
        rolling.exponential_means({f"ema{n}": ("close", n) for n in EMA_SPANS}),
        rolling.rolling_extreme(f"high_{HIGH_STEPS[-1]}", "high", HIGH_STEPS),
    )
    return core(df).drop(*[f"vol_mean_{n}" for n in POLE_LENGTHS if n != GAP_SCAN_SPAN])


def long_form(frame: DataFrame, columns: Sequence[str] = PUBLIC_COLUMNS) -> DataFrame:
    """One row per (symbol, ts, indicator) with a finite value."""
    long = frame.unpivot(["symbol", "ts"], list(columns), "indicator", "value")
    finite = ~F.isnan("value") & (F.abs("value") < float("inf"))
    return long.filter(F.col("value").isNotNull() & finite)


def measure(spans: DataFrame, indexed: DataFrame, chunk_rows: int = CHUNK) -> DataFrame:
    """Gain in percent and number of bars between two dates, per row of ``spans``.

    ``spans`` has symbol, from_ts and to_ts. The end closes are the first and last bars inside.
    """
    key = ["symbol", "from_ts", "to_ts"]
    located = locate_moves(spans, indexed, key=key, low="from_ts", high="to_ts", chunk_rows=chunk_rows)
    ends = bars_at(
        located, indexed, {"from": "rn_lo", "to": "rn_hi"}, ["close"], key=key, chunk_rows=chunk_rows
    )
    gain = (F.try_divide("to_close", "from_close") - 1) * 100.0
    return ends.select(*key, F.col("n_bars").alias("bars"), "from_close", "to_close", gain.alias("gain_pct"))

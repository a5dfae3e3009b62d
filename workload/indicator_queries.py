"""Queries for bars, indicators, swings, pivots and moves."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidebars.operators import best_moves as bm
from tidebars.operators import indicators, pivots, supertrend, swings
from tidebars.operators.resample import resample
from tidebars.plans.pipeline import prepare
from tidebars.series import index_series, locate_moves, move_bars
from workload import sql as q
from workload import tables as t
from workload.registry import num, query, when, whole

r = q.r
STAMP = f"{q.at('ts')} AS ts"


def averages(columns: list[str]) -> list:
    return ["symbol", when("ts"), *[num(c) for c in columns]]


@query("bars_from_events", q.with_(
    [q.BARS], f"SELECT symbol, {STAMP}, rn, open, high, low, close, volume FROM bars"))
def bars_from_events(spark, sf_dir):
    return t.bars(spark, sf_dir).select("symbol", when("ts"), whole("rn"), "open", "high", "low", "close", "volume")


@query("sma", q.with_([q.BARS, q.IND], f"SELECT symbol, {STAMP}, {r('sma50')} AS sma50, {r('sma150')} AS sma150, "
                                       f"{r('sma200')} AS sma200 FROM ind"))
def sma(spark, sf_dir):
    return indicators.moving_averages(t.bars(spark, sf_dir), ema=()).select(*averages(["sma50", "sma150", "sma200"]))


@query("ema", q.with_([q.BARS, q.EMA], f"SELECT symbol, {q.at('b.ts')} AS ts, {r('ema10')} AS ema10, "
                                       f"{r('ema20')} AS ema20 FROM ema JOIN bars b USING (symbol, rn)"))
def ema(spark, sf_dir):
    return indicators.moving_averages(t.bars(spark, sf_dir), sma=()).select(*averages(["ema10", "ema20"]))


SPANS = (1, 5, 20, 200, 400)


def ema_sql(bars: str) -> str:
    """Recursive exponential means of ``SPANS`` over ``bars``."""
    first = ", ".join(f"close AS ema{n}" for n in SPANS)
    step = ", ".join(f"2 / {n + 1}::DOUBLE * b.close + {n - 1} / {n + 1}::DOUBLE * e.ema{n}" for n in SPANS)
    return f"""
emas AS (
  SELECT symbol, rn, {first} FROM {bars} WHERE rn = 1
  UNION ALL
  SELECT b.symbol, b.rn, {step} FROM emas e JOIN {bars} b ON b.symbol = e.symbol AND b.rn = e.rn + 1)"""


SHOW_EMAS = ", ".join(f"{r(f'ema{n}')} AS ema{n}" for n in SPANS)


@query("custom_averages", q.with_([q.BARS, ema_sql("bars")],
    f"SELECT symbol, {q.at('b.ts')} AS ts, {r(q.full('avg', 'close', 45))} AS sma45, "
    f"{SHOW_EMAS} FROM emas JOIN bars b USING (symbol, rn)"))
def custom_averages(spark, sf_dir):
    df = indicators.moving_averages(t.bars(spark, sf_dir), sma=(45,), ema=SPANS)
    return df.select(*averages(["sma45", *[f"ema{n}" for n in SPANS]]))


@query("averages_of_dirty_bars", q.with_([q.BARS, """
numbered AS MATERIALIZED (
  SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars WHERE minute(ts) % 7 <> 3
)""", ema_sql("numbered")], f"SELECT symbol, {q.at('b.ts')} AS ts, {SHOW_EMAS} FROM emas JOIN numbered b USING (symbol, rn)"))
def averages_of_dirty_bars(spark, sf_dir):
    """Every seventh close is missing; ``prepare`` leaves such bars out before it numbers the rest."""
    raw = t.staged(spark, sf_dir, "raw_bars", lambda: t.raw_bars(spark, sf_dir))
    dirty = raw.withColumn("close", F.when(F.minute("ts") % 7 != 3, F.col("close")))
    ready = t.staged(spark, sf_dir, "dirty_bars", lambda: prepare(dirty).bars)
    return indicators.moving_averages(ready, sma=(), ema=SPANS).select(*averages([f"ema{n}" for n in SPANS]))


@query("volume_baseline", q.with_(
    [q.BARS, q.IND], f"SELECT symbol, {STAMP}, {r('avg_vol_50')} AS avg_vol_50, {r('rel_vol')} AS rel_vol FROM ind"))
def volume_baseline(spark, sf_dir):
    return indicators.volume_baseline(t.bars(spark, sf_dir)).select(*averages(["avg_vol_50", "rel_vol"]))


@query("range_measures", q.with_(
    [q.BARS, q.IND], f"SELECT symbol, {STAMP}, {r('true_range')} AS true_range, {r('adr_pct_20')} AS adr_pct_20, "
                     f"{r('atr_20')} AS atr_20 FROM ind"))
def range_measures(spark, sf_dir):
    return indicators.range_measures(t.bars(spark, sf_dir)).select(*averages(["true_range", "adr_pct_20", "atr_20"]))


@query("asof_benchmark", q.with_(
    [q.BARS, q.BENCH, q.ASOF], f"SELECT symbol, {STAMP}, {r('bench_close')} AS bench_close FROM aligned"))
def asof_benchmark(spark, sf_dir):
    df = indicators.align_benchmark(t.bars(spark, sf_dir), t.benchmark(spark, sf_dir))
    return df.select(*averages(["bench_close"]))


STRENGTH = """
strength AS (
  SELECT *, (close / lag(close, 63) OVER w) / (bench_close / lag(bench_close, 63) OVER w) AS rel_strength_63
  FROM aligned WINDOW w AS (PARTITION BY symbol ORDER BY rn)
)"""


@query("relative_strength", q.with_(
    [q.BARS, q.BENCH, q.ASOF, STRENGTH], f"SELECT symbol, {STAMP}, {r('rel_strength_63')} AS rel_strength_63 FROM strength"))
def relative_strength(spark, sf_dir):
    aligned = indicators.align_benchmark(t.bars(spark, sf_dir), t.benchmark(spark, sf_dir))
    return indicators.relative_strength(aligned).select(*averages(["rel_strength_63"]))


@query("benchmark_overlay", q.with_([q.BARS, q.BENCH, q.ASOF], f"""
SELECT symbol, {STAMP}, {r('close / first_value(close) OVER w * 100')} AS rebased,
  {r('bench_close / first_value(bench_close) OVER w * 100')} AS bench_rebased
FROM aligned WHERE bench_close IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY rn)"""))
def benchmark_overlay(spark, sf_dir):
    aligned = indicators.align_benchmark(t.bars(spark, sf_dir), t.benchmark(spark, sf_dir))
    shown = indicators.benchmark_overlay(aligned).filter(F.col("bench_close").isNotNull())
    return shown.select(*averages(["rebased", "bench_rebased"]))


ALL_COLUMNS = ["sma50", "sma150", "sma200", "ema10", "ema20", "avg_vol_50", "rel_vol", "adr_pct_20", "atr_20",
               "rel_strength_63"]
BUNDLE = [q.BARS, q.EMA, q.IND, q.BENCH, q.ASOF, STRENGTH, """
wide AS (SELECT i.*, e.ema10, e.ema20, s.rel_strength_63 FROM ind i JOIN ema e USING (symbol, rn)
  JOIN strength s USING (symbol, rn))"""]


@query("all_indicators", q.with_(
    BUNDLE, f"SELECT symbol, {STAMP}, " + ", ".join(f"{r(c)} AS {c}" for c in ALL_COLUMNS) + " FROM wide"))
def all_indicators(spark, sf_dir):
    df = indicators.all_indicators(t.bars(spark, sf_dir), t.benchmark(spark, sf_dir))
    return df.select(*averages(ALL_COLUMNS))


@query("indicator_long_form", q.with_(BUNDLE, " UNION ALL ".join(
    f"SELECT symbol, {STAMP}, '{c}' AS indicator, {r(c)} AS value FROM wide WHERE {c} IS NOT NULL" for c in ALL_COLUMNS)))
def indicator_long_form(spark, sf_dir):
    return indicators.long_form(t.frame(spark, sf_dir)).select("symbol", when("ts"), "indicator", num("value"))


@query("raw_swings", q.with_([q.BARS, q.SWINGS], f"SELECT symbol, {STAMP}, rn, kind, price FROM raw_swings"))
def raw_swings(spark, sf_dir):
    return swings.raw_swings(t.bars(spark, sf_dir)).select("symbol", when("ts"), whole("rn"), "kind", "price")


@query("swings", q.with_([q.BARS, q.SWINGS], f"SELECT symbol, {STAMP}, rn, kind, price, after_rn, last_rn FROM swings"))
def swing_points(spark, sf_dir):
    return swings.swings(t.bars(spark, sf_dir)).select("symbol", when("ts"), whole("rn"), "kind", "price", whole("after_rn"), whole("last_rn"))


def resampled(unit: str) -> str:
    return q.with_([q.DAILY], f"""
SELECT symbol, {q.day(f"date_trunc('{unit}', ts)")} AS period, first(open ORDER BY ts) AS open, max(high) AS high,
  min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume, count(*) AS bars
FROM dbars GROUP BY symbol, date_trunc('{unit}', ts)""")


def daily(spark, sf_dir):
    """Daily bars over seven years from orders, one symbol per priority."""
    t.utc(spark)
    ticks = t.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("at"),
        F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") / 50).cast("bigint").alias("cents"),
    )
    sums = t.staged(spark, sf_dir, "daily_sums", lambda: t.tick_sums(ticks, F.date_trunc("day", "at")))
    return t.staged(spark, sf_dir, "daily", lambda: t.walk(sums, t.PACE))


def daily_bars(spark, sf_dir):
    return t.staged(spark, sf_dir, "daily_bars", lambda: index_series(daily(spark, sf_dir)))


def resample_query(spark, sf_dir, unit):
    df = resample(daily(spark, sf_dir), unit)
    return df.select("symbol", F.date_format("ts", "yyyy-MM-dd").alias("period"), "open", "high", "low", "close",
                     "volume", "bars")


@query("weekly_bars", resampled("week"))
def weekly_bars(spark, sf_dir):
    return resample_query(spark, sf_dir, "week")


@query("monthly_bars", resampled("month"))
def monthly_bars(spark, sf_dir):
    return resample_query(spark, sf_dir, "month")


@query("measure", q.with_([q.DAILY], f"""
SELECT d.symbol, {q.at('s.a')} AS from_ts, {q.at('s.b')} AS to_ts, count(*) AS bars,
  first(close ORDER BY ts) AS from_close, last(close ORDER BY ts) AS to_close,
  {r('(last(close ORDER BY ts) / first(close ORDER BY ts) - 1) * 100')} AS gain_pct
FROM dbars d JOIN (SELECT symbol, min(ts) + INTERVAL 5 DAY AS a, max(ts) - INTERVAL 20 DAY AS b FROM dbars
                   GROUP BY symbol, year(ts)) s
  ON s.symbol = d.symbol AND d.ts BETWEEN s.a AND s.b GROUP BY d.symbol, s.a, s.b"""))
def measure(spark, sf_dir):
    bars = daily_bars(spark, sf_dir)
    spans = bars.groupBy("symbol", F.year("ts").alias("y")).agg(
        (F.min("ts") + F.expr("INTERVAL 5 DAYS")).alias("from_ts"), (F.max("ts") - F.expr("INTERVAL 20 DAYS")).alias("to_ts")
    ).drop("y")
    out = indicators.measure(spans, bars).filter(F.col("bars").isNotNull())
    return out.select("symbol", when("from_ts"), when("to_ts"), whole("bars"), "from_close", "to_close", num("gain_pct"))


# ---------- moves ----------

MOVE_SELECT = (f"SELECT symbol, year, {r('gain_pct')} AS gain_pct, {q.at('low_date')} AS low_date, "
               f"{q.at('high_date')} AS high_date, low_price, high_price, {r('avg_vol_b * 1e6')} AS avg_vol_k FROM moves")


def shown_moves(moves):
    return moves.select("symbol", "year", num("gain_pct"), when("low_date"), when("high_date"), "low_price",
                        "high_price", num(F.col("avg_vol_b") * 1e6, "avg_vol_k"))


@query("best_moves", q.with_([q.BARS, q.MOVES], MOVE_SELECT))
def best_moves(spark, sf_dir):
    return shown_moves(bm.best_moves(t.bars(spark, sf_dir), t.week(F.col("ts"))))


YEARLY = """
lows AS (
  SELECT *, year(ts)::INT AS year, min(close) OVER (PARTITION BY symbol, year(ts) ORDER BY ts ROWS UNBOUNDED PRECEDING) AS floor
  FROM dbars
), gains AS (SELECT *, (close / floor - 1) * 100 AS gain_pct FROM lows
), tops AS (SELECT *, row_number() OVER (PARTITION BY symbol, year ORDER BY gain_pct DESC, ts) AS k FROM gains
), moves AS MATERIALIZED (
  SELECT h.symbol, h.year, h.gain_pct, (SELECT min(l.ts) FROM dbars l WHERE l.symbol = h.symbol AND year(l.ts) = h.year
    AND l.close = h.floor) AS low_date, h.ts AS high_date, h.floor AS low_price, h.close AS high_price,
    (SELECT avg(v.volume) / 1e9 FROM dbars v WHERE v.symbol = h.symbol AND year(v.ts) = h.year) AS avg_vol_b
  FROM tops h WHERE k = 1 AND gain_pct > 0
)"""


@query("best_moves_yearly", q.with_([q.DAILY, YEARLY], MOVE_SELECT))
def best_moves_yearly(spark, sf_dir):
    return shown_moves(bm.best_moves(daily_bars(spark, sf_dir)))


DIRTY = """
dirty AS (
  SELECT *, CASE day(ts) % 9 WHEN 1 THEN NULL WHEN 2 THEN CASE WHEN month(ts) = 11 THEN 0 ELSE close END ELSE close END AS c FROM dbars
), dirty_lows AS (
  SELECT *, year(ts)::INT AS year, min(c) OVER (PARTITION BY symbol, year(ts) ORDER BY ts ROWS UNBOUNDED PRECEDING) AS floor FROM dirty WHERE c IS NOT NULL
), dirty_tops AS (
  SELECT *, (c / floor - 1) * 100 AS gain_pct, row_number() OVER (PARTITION BY symbol, year ORDER BY (c / floor - 1) DESC, ts) AS k
  FROM dirty_lows WHERE floor > 0
)"""


@query("best_moves_dirty_prices", q.with_([q.DAILY, DIRTY], f"""
SELECT symbol, year, {r('gain_pct')} AS gain_pct, {q.at('ts')} AS high_date, floor AS low_price, c AS high_price
FROM dirty_tops WHERE k = 1 AND gain_pct > 0"""))
def best_moves_dirty_prices(spark, sf_dir):
    """Null closes are skipped; a close of zero ends the gains of its period."""
    day, month = F.dayofmonth("ts"), F.month("ts")
    close = F.when(day % 9 == 1, F.lit(None)).when((day % 9 == 2) & (month == 11), F.lit(0.0)).otherwise(F.col("close"))
    bars = daily_bars(spark, sf_dir).withColumn("close", close)
    return bm.best_moves(bars).select("symbol", "year", num("gain_pct"), when("high_date"), "low_price", "high_price")


# Moves over the whole history of a symbol, filed under the year of their low: they cross years.
LONG_MOVES = """
all_lows AS (
  SELECT *, min(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS floor FROM dbars
), all_tops AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY (close / floor - 1) * 100 DESC, ts) AS k FROM all_lows
), long_moves AS (
  SELECT symbol, round((close / floor - 1) * 100, 2) AS gain_pct, (SELECT min(l.ts) FROM dbars l WHERE l.symbol = h.symbol
    AND l.close = h.floor) AS low_date, ts AS high_date, round(floor, 3) AS low_price, round(close, 3) AS high_price FROM all_tops h WHERE k = 1
), book AS MATERIALIZED (
  SELECT year(low_date)::INT AS year, symbol, gain_pct, low_date, high_date, low_price, high_price, 'whole history' AS note
  FROM long_moves
  UNION ALL
  SELECT m.year, m.symbol, round(m.gain_pct, 2), m.low_date, m.high_date, round(m.low_price, 3), round(m.high_price, 3), 'year'
  FROM moves m WHERE m.gain_pct >= 60
    AND NOT EXISTS (SELECT 1 FROM long_moves l WHERE l.symbol = m.symbol AND year(l.low_date) = m.year)
), crossing AS MATERIALIZED (
  SELECT * FROM book WHERE year(low_date) <> year OR year(high_date) <> year
), touched AS MATERIALIZED (
  SELECT c.*, unnest(range(year(low_date)::BIGINT, year(high_date)::BIGINT + 1))::INT AS covered FROM crossing c
), plan AS MATERIALIZED (
  SELECT c.symbol, c.year, c.note, c.covered, m.gain_pct AS new_gain, m.low_date AS new_low, m.high_date AS new_high,
    CASE WHEN m.symbol IS NULL THEN 'no_move'
         WHEN c.covered <> c.year AND EXISTS (SELECT 1 FROM book b WHERE b.symbol = c.symbol AND b.year = c.covered)
         THEN 'exists' END AS reason
  FROM touched c LEFT JOIN moves m ON m.symbol = c.symbol AND m.year = c.covered
)"""
TO_PLAN = [q.DAILY, YEARLY, LONG_MOVES]
ACTION = "CASE WHEN reason IS NOT NULL THEN 'SKIP' WHEN covered = year THEN 'REWRITE' ELSE 'ADD' END"


def book(spark, sf_dir):
    """A moves table that needs repair: whole-history moves plus large yearly ones."""
    def build():
        bars = daily_bars(spark, sf_dir)
        long = bm.best_moves(bars, F.lit(0)).withColumn("year", F.year("low_date")).withColumn("note", F.lit("whole history"))
        yearly = bm.best_moves(bars).filter(F.col("gain_pct") >= 60).withColumn("note", F.lit("year"))
        yearly = yearly.join(long.select("symbol", "year"), ["symbol", "year"], "left_anti").select(*long.columns)
        return bm.rounded_moves(long.unionByName(yearly))
    return t.staged(spark, sf_dir, "book", build)


@query("cross_period_moves", q.with_(
    TO_PLAN, f"SELECT symbol, year, {q.at('low_date')} AS low_date, {q.at('high_date')} AS high_date FROM crossing"))
def cross_period_moves(spark, sf_dir):
    return bm.cross_period(book(spark, sf_dir)).select("symbol", "year", when("low_date"), when("high_date"))


@query("periods_covered", q.with_(TO_PLAN, "SELECT symbol, year, covered FROM touched"))
def periods_covered(spark, sf_dir):
    return bm.periods_covered(bm.cross_period(book(spark, sf_dir))).select("symbol", "year", "covered")


def shown_plan(plan):
    return plan.select("symbol", "year", "covered", "note", "action", "reason", num("new_gain_pct"),
                       when("new_low_date"), when("new_high_date"))


@query("repair_plan", q.with_(TO_PLAN, f"""
SELECT symbol, year, covered, note, {ACTION} AS action, reason, {r('round(new_gain, 2)')} AS new_gain_pct,
  {q.at('new_low')} AS new_low_date, {q.at('new_high')} AS new_high_date FROM plan"""))
def repair_plan(spark, sf_dir):
    return shown_plan(bm.repair_plan(book(spark, sf_dir), daily_bars(spark, sf_dir)))


@query("repair_summary", q.with_(
    TO_PLAN, f"SELECT {ACTION} AS action, reason, count(*) AS n FROM plan GROUP BY ALL"))
def repair_summary(spark, sf_dir):
    return bm.repair_summary(bm.repair_plan(book(spark, sf_dir), daily_bars(spark, sf_dir)))


@query("apply_repair", q.with_(TO_PLAN, f"""
SELECT year, symbol, {r('gain_pct')} AS gain_pct, {q.at('low_date')} AS low_date, {q.at('high_date')} AS high_date, note
FROM book b WHERE NOT EXISTS (
  SELECT 1 FROM plan p WHERE p.symbol = b.symbol AND p.covered = b.year AND {ACTION} = 'REWRITE')
UNION ALL
SELECT covered, symbol, {r('round(new_gain, 2)')}, {q.at('new_low')}, {q.at('new_high')}, note
FROM plan WHERE {ACTION} <> 'SKIP'"""))
def apply_repair(spark, sf_dir):
    moves = book(spark, sf_dir)
    plan = t.staged(spark, sf_dir, "repair_plan", lambda: bm.repair_plan(moves, daily_bars(spark, sf_dir)))
    fixed = bm.apply_repair(moves, plan)
    return fixed.select("year", "symbol", num("gain_pct"), when("low_date"), when("high_date"), "note")


# ---------- pivots ----------

@query("move_window", q.with_([q.BARS, q.MOVES], f"""
SELECT m.symbol, m.year, {q.at('b.ts')} AS ts, b.rn - m.rn_lo AS pos, m.n_bars, b.close
FROM moves m JOIN bars b ON b.symbol = m.symbol AND b.ts BETWEEN m.low_date AND m.high_date"""))
def move_window(spark, sf_dir):
    bars = t.bars(spark, sf_dir)
    located = locate_moves(t.moves(spark, sf_dir).drop("rn_lo", "rn_hi", "n_bars"), bars)
    return move_bars(located, bars).select("symbol", "year", when("ts"), whole("pos"), whole("n_bars"), "close")


@query("pivot_candidates", q.with_(q.TO_PIVOTS[:3] + (q.PAIRS,), f"""
SELECT symbol, year, rn, len::INT AS base_len, base_high, base_low, {r('depth')} AS depth, {r('quality')} AS quality_score
FROM scored"""))
def pivot_candidates(spark, sf_dir):
    df = pivots.candidates(t.moves(spark, sf_dir), t.frame(spark, sf_dir))
    return df.select("symbol", "year", whole("rn"), "base_len", "base_high", "base_low", num("depth"), num("quality_score"))


PIVOT_SELECT = f"""
SELECT p.symbol, p.year, {q.at(q.bar('ts', 'p.rn_pivot'))} AS pivot_date, p.pos AS pivot_idx_in_window,
  {q.at(q.bar('ts', 'p.rn_bs'))} AS base_start, {q.at(q.bar('ts', 'p.rn_be'))} AS base_end, base_high, base_low,
  {r('depth_pct')} AS base_depth_pct, {r('rel_vol')} AS breakout_rel_vol, close AS breakout_close,
  {r('quality')} AS quality_score"""


def shown_pivots(df):
    return df.select(
        "symbol", "year", when("pivot_date"), whole("pivot_idx_in_window"), when("base_start"), when("base_end"),
        "base_high", "base_low", num("base_depth_pct"), num("breakout_rel_vol"), "breakout_close", num("quality_score"))


@query("pivots", q.with_(q.TO_PIVOTS, PIVOT_SELECT + " FROM pivots p"))
def pivot_records(spark, sf_dir):
    return shown_pivots(pivots.pivots(t.moves(spark, sf_dir), t.frame(spark, sf_dir)))


@query("pivot_lookup", q.with_(q.TO_PIVOTS, PIVOT_SELECT + """
FROM (SELECT m.symbol, m.year, v.* EXCLUDE (symbol, year) FROM moves m
      LEFT JOIN pivots v ON v.symbol = m.symbol AND v.year = m.year WHERE m.symbol = 'click_1' AND m.year = 2818) p"""))
def pivot_lookup(spark, sf_dir):
    return shown_pivots(pivots.pivot_lookup(t.moves(spark, sf_dir), t.pivot_table(spark, sf_dir), "CLICK_1", 2818))


# ---------- trend bands ----------

BAND_FACTORS = (1.0, 3.0)
BAND_STEPS = [q.BARS, q.IND, """
first_band AS (SELECT symbol, min(rn) AS rn FROM ind WHERE atr_20 IS NOT NULL GROUP BY symbol
), bands AS (
  SELECT i.symbol, i.rn, g.f, (i.high + i.low) / 2 + g.f * i.atr_20 AS u, (i.high + i.low) / 2 - g.f * i.atr_20 AS l,
    i.close, 1 AS trend
  FROM ind i JOIN first_band USING (symbol, rn), (SELECT unnest([1.0::DOUBLE, 3.0::DOUBLE]) AS f) g
  UNION ALL
  SELECT symbol, rn, f, u, l, close, CASE WHEN close > u THEN 1 WHEN close < l THEN -1 ELSE trend END
  FROM (
    SELECT i.symbol, i.rn, b.f, i.close, b.trend,
      CASE WHEN (i.high + i.low) / 2 + b.f * i.atr_20 < b.u OR b.close > b.u THEN (i.high + i.low) / 2 + b.f * i.atr_20 ELSE b.u END AS u,
      CASE WHEN (i.high + i.low) / 2 - b.f * i.atr_20 > b.l OR b.close < b.l THEN (i.high + i.low) / 2 - b.f * i.atr_20 ELSE b.l END AS l
    FROM bands b JOIN ind i ON i.symbol = b.symbol AND i.rn = b.rn + 1)
)"""]


def shown_bands(df):
    tried = f"array({', '.join(f'{f!r}D' for f in BAND_FACTORS)})"
    each = f"explode(transform(trend, (x, i) -> named_struct('factor', {tried}[i], 'trend', x, 'line', line[i])))"
    return df.select("symbol", whole("rn"), F.expr(each).alias("b")).select(
        "symbol", "rn", "b.factor", "b.trend", num("b.line", "line"))


@query("trend_bands", q.with_(BAND_STEPS, f"""
SELECT symbol, rn, f AS factor, trend, {r('CASE WHEN trend > 0 THEN l ELSE u END')} AS line FROM bands"""))
def trend_bands(spark, sf_dir):
    return shown_bands(supertrend.trend_bands(t.frame(spark, sf_dir), BAND_FACTORS))


# the recursion with the performance of every factor, the factor of each bar by trying all cuts, and the bands with it
ADAPTIVE_STEPS = [q.BARS, q.IND, f"""
first_band AS (SELECT symbol, min(rn) AS rn FROM ind WHERE atr_20 IS NOT NULL GROUP BY symbol
), tried AS (
  SELECT i.symbol, i.rn, g.f, (i.high + i.low) / 2 + g.f * i.atr_20 AS u, (i.high + i.low) / 2 - g.f * i.atr_20 AS l,
    i.close, 1 AS trend, 0.0::DOUBLE AS perf
  FROM ind i JOIN first_band USING (symbol, rn), (SELECT unnest([{', '.join(f'{f!r}::DOUBLE' for f in supertrend.FACTORS)}]) AS f) g
  UNION ALL
  SELECT symbol, rn, f, u, l, close, CASE WHEN close > u THEN 1 WHEN close < l THEN -1 ELSE trend END,
    perf + 2.0::DOUBLE / {supertrend.MEMORY + 1} * (moved - perf)
  FROM (
    SELECT i.symbol, i.rn, b.f, i.close, b.trend, b.perf, b.trend * (i.close - b.close) AS moved,
      CASE WHEN (i.high + i.low) / 2 + b.f * i.atr_20 < b.u OR b.close > b.u THEN (i.high + i.low) / 2 + b.f * i.atr_20 ELSE b.u END AS u,
      CASE WHEN (i.high + i.low) / 2 - b.f * i.atr_20 > b.l OR b.close < b.l THEN (i.high + i.low) / 2 - b.f * i.atr_20 ELSE b.l END AS l
    FROM tried b JOIN ind i ON i.symbol = b.symbol AND i.rn = b.rn + 1)
), ranked AS (
  SELECT symbol, rn, list(q ORDER BY q, f) AS qs, list(f ORDER BY q, f) AS fs
  FROM (SELECT symbol, rn, f, round(perf / {supertrend.TICK!r}::DOUBLE) AS q FROM tried) GROUP BY symbol, rn
), cuts AS (
  SELECT a.i, b.j FROM range(1, 8) a(i), range(2, 9) b(j) WHERE a.i < b.j
), chosen AS (
  SELECT symbol, rn, list_sum(fs[j + 1:]) / (9 - j) AS factor FROM (
    SELECT r.*, c.j, row_number() OVER (PARTITION BY symbol, rn ORDER BY
      (list_sum(qs[1:i]) * list_sum(qs[1:i]) / i + list_sum(qs[i + 1:j]) * list_sum(qs[i + 1:j]) / (j - i))
      + list_sum(qs[j + 1:]) * list_sum(qs[j + 1:]) / (9 - j) DESC, i, j) AS k
    FROM ranked r, cuts c) WHERE k = 1
), own AS MATERIALIZED (
  SELECT i.symbol, i.rn, i.close, c.factor, (i.high + i.low) / 2 + c.factor * i.atr_20 AS up, (i.high + i.low) / 2 - c.factor * i.atr_20 AS down
  FROM ind i JOIN chosen c USING (symbol, rn)
), bands AS (
  SELECT o.symbol, o.rn, o.factor, o.up AS u, o.down AS l, o.close, 1 AS trend FROM own o JOIN first_band USING (symbol, rn)
  UNION ALL
  SELECT symbol, rn, factor, u, l, close, CASE WHEN close > u THEN 1 WHEN close < l THEN -1 ELSE trend END
  FROM (
    SELECT o.symbol, o.rn, o.factor, o.close, b.trend, CASE WHEN o.up < b.u OR b.close > b.u THEN o.up ELSE b.u END AS u,
      CASE WHEN o.down > b.l OR b.close < b.l THEN o.down ELSE b.l END AS l
    FROM bands b JOIN own o ON o.symbol = b.symbol AND o.rn = b.rn + 1)
)"""]


@query("adaptive_bands", q.with_(ADAPTIVE_STEPS, f"""
SELECT symbol, rn, {r('factor')} AS factor, trend, {r('CASE WHEN trend > 0 THEN l ELSE u END', 8)} AS line FROM bands"""))
def adaptive_bands(spark, sf_dir):
    return shown_adaptive(supertrend.adaptive_bands(t.frame(spark, sf_dir)))


def shown_adaptive(df):
    # edges have seven decimals at most
    return df.select("symbol", whole("rn"), num("factor"), "trend", num("line", places=8))

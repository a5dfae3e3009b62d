"""Moves of any range of bars from chunk summaries, and indicators over bars laid out by chunk; chunks are short, so that there are several."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidebars.operators import best_moves as bm
from tidebars.operators import indicators
from tidebars.operators import range_moves as rm
from tidebars.series import index_series
from tidebars.session import stage_path
from tidebars.sources import layout
from workload import chunk_queries as cq
from workload import indicator_queries as iq
from workload import sql as q
from workload import tables as t
from workload.registry import CHECKS, num, query, when

r = iq.r
WEEKS = 3       # a span: a week and the two after it
DAYS_CUT = 64


def summaries(spark, sf_dir):
    return t.staged(spark, sf_dir, "chunk_summaries", lambda: rm.chunk_summaries(cq.bars(spark, sf_dir)))


def spans(bars):
    """One overlapping span per symbol and week that has bars."""
    weeks = bars.select("symbol", t.week(F.col("ts")).alias("year")).distinct()
    first = F.timestamp_seconds(F.col("year") * F.lit(t.WEEK_SECONDS) - 3 * 86400)
    last = F.timestamp_seconds((F.col("year") + WEEKS) * F.lit(t.WEEK_SECONDS) - 3 * 86400 - 1)
    return weeks.select("symbol", "year", first.alias("from_ts"), last.alias("to_ts"))


@query("best_moves_of_spans", q.with_([q.BARS, f"""
spans AS (
  SELECT DISTINCT symbol, {q.WEEK.format('ts')} AS year FROM bars
), span_bars AS MATERIALIZED (
  SELECT s.symbol, s.year, b.rn, b.ts, b.close, b.volume FROM spans s JOIN bars b ON b.symbol = s.symbol
    AND {q.WEEK.format('b.ts')} BETWEEN s.year AND s.year + {WEEKS - 1}
), span_lows AS (
  SELECT *, min(close) OVER (PARTITION BY symbol, year ORDER BY rn ROWS UNBOUNDED PRECEDING) AS floor FROM span_bars
), span_tops AS (
  SELECT *, (close / floor - 1) * 100 AS gain_pct,
    row_number() OVER (PARTITION BY symbol, year ORDER BY (close / floor - 1) * 100 DESC, rn) AS k FROM span_lows
)"""], f"""
SELECT h.symbol, h.year, {r('h.gain_pct')} AS gain_pct, {q.at('(SELECT min(l.ts) FROM span_bars l WHERE l.symbol = h.symbol AND l.year = h.year AND l.close = h.floor)')} AS low_date,
  {q.at('h.ts')} AS high_date, h.floor AS low_price, h.close AS high_price,
  {r('(SELECT avg(v.volume) / 1e9 FROM span_bars v WHERE v.symbol = h.symbol AND v.year = h.year)', 9)} AS avg_vol_b
FROM span_tops h WHERE k = 1 AND gain_pct > 0"""))
def best_moves_of_spans(spark, sf_dir):
    bars = cq.bars(spark, sf_dir)
    found = rm.best_in(spans(bars), bars, summaries(spark, sf_dir), chunk_rows=cq.CUT)
    return found.select("symbol", "year", num("gain_pct"), when("low_date"), when("high_date"), "low_price", "high_price", num("avg_vol_b", places=9))


@query("repair_plan_by_summaries", CHECKS["repair_plan"])
def repair_plan_by_summaries(spark, sf_dir):
    """The plan of repair_plan; of the years in question only the chunks at their ends are read."""
    bars = t.staged(spark, sf_dir, "cut_daily", lambda: index_series(iq.daily_bars(spark, sf_dir).drop("rn", "chunk"), chunk_rows=DAYS_CUT))
    held = t.staged(spark, sf_dir, "daily_summaries", lambda: rm.chunk_summaries(bars))
    plan = bm.repair_plan(iq.book(spark, sf_dir), bars, search=lambda asked: rm.best_of_periods(asked, bars, held, chunk_rows=DAYS_CUT))
    return iq.shown_plan(plan)


@query("all_indicators_laid_out", CHECKS["all_indicators"])
def all_indicators_laid_out(spark, sf_dir):
    """Bars aligned with their benchmark and written with their halo; the indicators over them need no exchange."""
    aligned = indicators.align_benchmark(cq.bars(spark, sf_dir), t.benchmark(spark, sf_dir))
    path = stage_path(spark, "laid_out")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    layout.lay_out(aligned, name, path, buckets=8, chunk_rows=cq.CUT)
    return indicators.all_indicators(layout.laid_out(spark, name, chunk_rows=cq.CUT), chunk_rows=cq.CUT).select(*iq.averages(iq.ALL_COLUMNS))

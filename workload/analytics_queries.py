"""Queries for the quality of moves."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidebars.operators import analytics as a
from workload import sql as q
from workload import tables as t
from workload.registry import num, query, when, whole
from workload.setup_queries import classified

r = q.r
STATS = q.stats_cte()
TO_STATS = (*q.TO_INSIDE, STATS)
TO_SCREEN = (*TO_STATS, q.GAPS, q.STREAKS, q.SCREEN)
COUNTS = ("days", "sma50_touches", "days_below_50", "days_u10")
RATES = ("ema10_pct", "ema20_pct", "worst_dd_pct", "pct_u10", "adr")
PRICES = ("px_start", "px_end", "low", "high")


def stat_select(keys: str, source: str) -> str:
    parts = [*COUNTS, *[f"{r(c)} AS {c}" for c in RATES], *PRICES, f"{q.at('first_ts')} AS first_ts", f"{q.at('last_ts')} AS last_ts"]
    return f"SELECT {keys}, {', '.join(parts)} FROM {source}"


def shown_stats(df, *keys):
    return df.select(*keys, *[whole(c) for c in COUNTS], *[num(c) for c in RATES], *PRICES, when("first_ts"), when("last_ts"))


def stats(spark, sf_dir):
    return t.staged(spark, sf_dir, "stats", lambda: a.window_stats(t.inside(spark, sf_dir)))


@query("window_stats", q.with_(TO_STATS, stat_select("symbol, year", "stats")))
def window_stats(spark, sf_dir):
    return shown_stats(a.window_stats(t.inside(spark, sf_dir)), "symbol", "year")


QUARTERS = (*q.TO_INSIDE, """
sliced AS (
  SELECT *, CASE WHEN pos < n_bars // 4 THEN 1 WHEN pos < n_bars // 2 THEN 2 WHEN pos < 3 * n_bars // 4 THEN 3 ELSE 4 END
    AS quarter FROM inside
)""", q.stats_cte("quarters", "sliced", "symbol, year, quarter"))


@query("quarter_stats", q.with_(QUARTERS, stat_select("symbol, year, quarter", "quarters")))
def quarter_stats(spark, sf_dir):
    return shown_stats(a.quarter_stats(t.inside(spark, sf_dir)), "symbol", "year", "quarter")


@query("gap_scan", q.with_((*q.TO_INSIDE, q.GAPS), f"""
SELECT symbol, year, {q.at('ts')} AS ts, {r('gap_pct')} AS gap_pct, {r('rel_vol_20')} AS rel_vol_20,
  {r('close_pct')} AS close_pct, label FROM gaps"""))
def gap_scan(spark, sf_dir):
    df = a.gap_scan(t.inside(spark, sf_dir))
    return df.select("symbol", "year", when("ts"), num("gap_pct"), num("rel_vol_20"), num("close_pct"), "label")


@query("longest_streak", q.with_((*q.TO_INSIDE, q.STREAKS), f"""
SELECT symbol, year, {q.at('streak_start')} AS streak_start, {q.at('streak_end')} AS streak_end, streak_days, streak_weeks
FROM streaks"""))
def longest_streak(spark, sf_dir):
    df = a.longest_streak(t.inside(spark, sf_dir))
    return df.select("symbol", "year", when("streak_start"), when("streak_end"), whole("streak_days"), whole("streak_weeks"))


@query("move_lookup", q.with_((q.BARS, q.MOVES), f"""
SELECT symbol, year, {r('gain_pct')} AS gain_pct, {q.at('low_date')} AS low_date FROM moves WHERE symbol = 'view_2' AND year = 2820"""))
def move_lookup(spark, sf_dir):
    return a.move_lookup(t.moves(spark, sf_dir), "view_2", 2820).select("symbol", "year", num("gain_pct"), when("low_date"))


@query("trend_slope", q.with_(q.TO_INSIDE, f"""
SELECT symbol, year, {r('regr_slope(close, pos)')} AS slope,
  {r('regr_slope(close, pos) / first(close ORDER BY rn) * 100')} AS slope_pct FROM inside GROUP BY symbol, year"""))
def trend_slope(spark, sf_dir):
    return a.trend_slope(t.inside(spark, sf_dir)).select("symbol", "year", num("slope"), num("slope_pct"))


RETRACE = (q.BARS, q.SWINGS, q.MOVES, """
ordered AS (
  SELECT m.symbol, m.year, s.rn, s.ts, s.kind, s.price, lag(s.price) OVER w AS low_before, lead(s.price) OVER w AS low_after
  FROM moves m JOIN swings s ON s.symbol = m.symbol AND s.rn BETWEEN m.rn_lo AND m.rn_hi
  WINDOW w AS (PARTITION BY m.symbol, m.year ORDER BY s.rn)
), retraced AS MATERIALIZED (
  SELECT symbol, year, ts, CASE WHEN price > low_before THEN (price - low_after) / (price - low_before) END AS ratio
  FROM ordered WHERE kind = 'high' AND low_before IS NOT NULL AND low_after IS NOT NULL
)""")


@query("retracements", q.with_(RETRACE, f"SELECT symbol, year, {q.at('ts')} AS ts, {r('ratio')} AS retracement FROM retraced"))
def retracements(spark, sf_dir):
    df = a.retracements(t.moves(spark, sf_dir), t.swing_table(spark, sf_dir))
    return df.select("symbol", "year", when("ts"), num("retracement"))


@query("retracement_summary", q.with_(RETRACE, f"""
SELECT symbol, year, count(ratio) AS pullbacks, {r('max(ratio)')} AS worst, {r('avg(ratio)')} AS mean,
  CASE WHEN max(ratio) < 0.5 THEN 'fine' WHEN max(ratio) > 0.6 THEN 'rejected' ELSE 'borderline' END AS verdict
FROM retraced GROUP BY symbol, year"""))
def retracement_summary(spark, sf_dir):
    df = a.retracement_summary(a.retracements(t.moves(spark, sf_dir), t.swing_table(spark, sf_dir)))
    return df.select("symbol", "year", "pullbacks", num("worst"), num("mean"), "verdict")


CHECKS = ["trend_ok", "touches_ok", "adr_ok", "gap_ok", "streak_ok"]


def screen(spark, sf_dir):
    inside = t.inside(spark, sf_dir)
    return a.quick_screen(a.window_stats(inside), a.gap_scan(inside), a.longest_streak(inside))


@query("quick_screen", q.with_(TO_SCREEN, f"SELECT symbol, year, {', '.join(CHECKS)}, misses, screen FROM screen"))
def quick_screen(spark, sf_dir):
    return screen(spark, sf_dir).select("symbol", "year", *CHECKS, "misses", "screen")


@query("gap_labels", q.with_((*q.TO_INSIDE, q.GAPS), f"""
SELECT symbol, year, count(*) FILTER (label = 'REAL') AS real, count(*) FILTER (label = 'MID') AS mid,
  count(*) FILTER (label = 'TRAP') AS trap, {r("count(*) FILTER (label = 'REAL') / count(*)")} AS hit_rate
FROM gaps GROUP BY symbol, year"""))
def gap_labels(spark, sf_dir):
    df = a.gap_labels(a.gap_scan(t.inside(spark, sf_dir)))
    return df.select("symbol", "year", "real", "mid", "trap", num("hit_rate"))


_BY = ("ema10_pct", "worst_dd_pct", "adr")


@query("metrics_by_verdict", q.with_(TO_SCREEN, "SELECT s.screen AS verdict, count(*) AS moves, " + ", ".join(
    f"{r(f'{n}(t.{c})')} AS {n}_{c}" for c in _BY for n in ("avg", "min", "max")) + """
FROM stats t JOIN screen s USING (symbol, year) GROUP BY ROLLUP (s.screen)"""))
def metrics_by_verdict(spark, sf_dir):
    verdicts = screen(spark, sf_dir).withColumnRenamed("screen", "verdict")
    df = a.metrics_by_verdict(stats(spark, sf_dir), verdicts, _BY)
    return df.select("verdict", "moves", *[num(f"{n}_{c}") for c in _BY for n in ("avg", "min", "max")])


@query("gain_correlation", q.with_(TO_STATS, "SELECT count(*) AS moves, " + ", ".join(
    f"{r(f'corr(m.gain_pct, t.{c})')} AS {c}" for c in a.STAT_COLUMNS) + " FROM moves m JOIN stats t USING (symbol, year)"))
def gain_correlation(spark, sf_dir):
    df = a.gain_correlation(t.moves(spark, sf_dir), stats(spark, sf_dir))
    return df.select("moves", *[num(c) for c in a.STAT_COLUMNS])


# ---------- annotations ----------
# Study notes derived from the moves: tags from how a move ended, grades from its gain.

def annotations(spark, sf_dir):
    gain = F.col("gain_pct")
    tags = F.array_compact(F.array(
        F.when(F.col("n_bars") >= 40, "Flat Base"), F.when(gain >= 40, "EP"), F.when(gain < 20, "VCP"),
        F.when(F.col("n_bars") < 20, "Breakout"),
    ))
    return t.moves(spark, sf_dir).select(
        "symbol", "year", F.concat_ws("_", "symbol", "year").alias("move_key"), "gain_pct",
        F.when(gain >= 15, "long").otherwise("").alias("direction"),
        F.when(gain >= 40, "A").when(gain >= 25, "B").when(gain >= 15, "C").otherwise("D").alias("rating"), tags.alias("tags"))


NOTES = """
notes AS MATERIALIZED (
  SELECT symbol, year, symbol || '_' || year AS move_key, gain_pct, CASE WHEN gain_pct >= 15 THEN 'long' ELSE '' END AS direction,
    CASE WHEN gain_pct >= 40 THEN 'A' WHEN gain_pct >= 25 THEN 'B' WHEN gain_pct >= 15 THEN 'C' ELSE 'D' END AS rating,
    list_filter([CASE WHEN n_bars >= 40 THEN 'Flat Base' END, CASE WHEN gain_pct >= 40 THEN 'EP' END,
      CASE WHEN gain_pct < 20 THEN 'VCP' END, CASE WHEN n_bars < 20 THEN 'Breakout' END], lambda x: x IS NOT NULL) AS tags
  FROM moves
)"""
HUMAN = (*q.TO_CLASSIFIED, NOTES, """
agreed AS MATERIALIZED (
  SELECT c.symbol, c.year, c.ai_primary, h.human, CASE WHEN len(h.human) = 0 THEN c.ai_primary IS NULL
    ELSE coalesce(list_contains(h.human, c.ai_primary), false) END AS agrees
  FROM classified c JOIN (
    SELECT symbol, year, CASE WHEN rating = 'B' THEN ['VCP'] ELSE
      list_filter(list_transform(tags, lambda x: CASE x WHEN 'EP' THEN 'Episodic Pivot' ELSE x END), lambda x: x <> 'Breakout')
      END AS human FROM notes) h USING (symbol, year)
)""")


def agreed(spark, sf_dir):
    human = annotations(spark, sf_dir).withColumn("user_primary", F.when(F.col("rating") == "B", "VCP"))
    return a.agreement(classified(spark, sf_dir), human)


@query("agreement", q.with_(HUMAN, "SELECT symbol, year, ai_primary, array_to_string(human, ',') AS human, agrees FROM agreed"))
def agreement(spark, sf_dir):
    df = agreed(spark, sf_dir)
    return df.select("symbol", "year", "ai_primary", F.array_join("human", ",").alias("human"), "agrees")


@query("agreement_confusion", q.with_(HUMAN, """
SELECT coalesce(ai_primary, '(none)') AS machine, h AS human, count(*) AS n
FROM (SELECT ai_primary, unnest(CASE WHEN len(human) = 0 THEN ['(none)'] ELSE human END) AS h FROM agreed) GROUP BY ALL"""))
def agreement_confusion(spark, sf_dir):
    return a.confusion(agreed(spark, sf_dir))


@query("library_view", q.with_((*q.TO_CLASSIFIED, NOTES), f"""
SELECT n.symbol, n.year, n.rating, {r('n.gain_pct')} AS gain_pct, c.ai_primary FROM notes n JOIN classified c USING (symbol, year)
WHERE n.direction = 'long' AND n.rating IN ('A', 'B') AND n.gain_pct >= 20 AND list_contains(n.tags, 'Flat Base')"""))
def library_view(spark, sf_dir):
    library = annotations(spark, sf_dir).join(classified(spark, sf_dir).select("symbol", "year", "ai_primary"), ["symbol", "year"])
    df = a.library_view(library, tag="Flat Base", direction="long", min_rating="B", min_gain=20)
    return df.select("symbol", "year", "rating", num("gain_pct"), "ai_primary")


@query("tag_counts", q.with_((q.BARS, q.MOVES, NOTES), "SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM notes) GROUP BY tag"))
def tag_counts(spark, sf_dir):
    return a.tag_counts(annotations(spark, sf_dir))


@query("rename_tag", q.with_((q.BARS, q.MOVES, NOTES), """
SELECT move_key, array_to_string(list_filter(list_transform(tags, lambda x: CASE x WHEN 'Breakout' THEN 'VCP' ELSE x END),
  lambda x, i: NOT (x = 'VCP' AND i > 1 AND list_contains(tags, 'VCP') AND tags[i] = 'Breakout')), ',') AS tags FROM notes"""))
def rename_tag(spark, sf_dir):
    df = a.rename_tag(annotations(spark, sf_dir), "Breakout", "VCP")
    return df.select("move_key", F.array_join("tags", ",").alias("tags"))


@query("delete_tag", q.with_((q.BARS, q.MOVES, NOTES), """
SELECT move_key, array_to_string(list_filter(tags, lambda x: x <> 'VCP'), ',') AS tags FROM notes"""))
def delete_tag(spark, sf_dir):
    df = a.delete_tag(annotations(spark, sf_dir), "VCP")
    return df.select("move_key", F.array_join("tags", ",").alias("tags"))


@query("stop_levels", q.with_((q.BARS, q.IND, q.MOVES, q.PIVOTS, q.EP), f"""
SELECT p.symbol, p.year, {r('p.base_low * 0.92::DOUBLE')} AS base_stop, {q.at('e.ts')} AS gap_date,
  {r('e.low * 0.92::DOUBLE')} AS gap_stop FROM pivots p JOIN ep e USING (symbol, year)"""))
def stop_levels(spark, sf_dir):
    df = a.stop_levels(t.pivot_table(spark, sf_dir), t.move_features(spark, sf_dir), t.frame(spark, sf_dir))
    return df.select("symbol", "year", num("base_stop"), when("gap_date"), num("gap_stop"))

"""Queries for features, detectors, resolution and the maintained tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidebars.operators import features as feat
from tidebars.operators import resolve, tables
from tidebars.operators.setups import detect, detect_all, register
from workload import sql as q
from workload import tables as t
from workload.indicator_queries import daily
from workload.registry import num, query, when, whole

r = q.r


def criteria_text():
    return F.concat_ws("", F.transform(
        "result.criteria", lambda c: F.concat(c["name"], F.lit("="), c["met"].cast("string"), F.lit(";"))))


@query("base_features", q.with_((q.BARS, q.IND, q.MOVES, q.PIVOTS, q.BASE), f"""
SELECT symbol, year, base_len::INT AS base_len, {r('prior_gain')} AS prior_gain, {r('base_volume')} AS base_volume,
  {r('last10_volume')} AS last10_volume, {r('slope_ratio', 8)} AS slope_ratio, {r('start_sma50')} AS start_sma50,
  {r('end_sma50')} AS end_sma50, {r('close_pos')} AS close_pos, {r('(high_252 - close) / high_252')} AS off_high FROM base"""))
def base_features(spark, sf_dir):
    df = feat.move_features(t.pivot_table(spark, sf_dir), t.frame(spark, sf_dir))
    return df.select("symbol", "year", "base_len", num("prior_gain"), num("base_volume"), num("last10_volume"),
                     num("slope_ratio", places=8), num("start_sma50"), num("end_sma50"), num("p_close_pos", "close_pos"),
                     num("off_high"))


@query("contractions", q.with_((q.BARS, q.IND, q.SWINGS, q.MOVES, q.PIVOTS, q.CONTRACTIONS), f"""
SELECT symbol, year, n_contr, n_rises, {r('last_contr')} AS last_contraction FROM contr"""))
def contractions(spark, sf_dir):
    return t.move_features(spark, sf_dir).select(
        "symbol", "year", whole("n_contractions", "n_contr"), whole("n_rises"), num("last_contraction"))


@query("gap_events", q.with_((q.BARS, q.IND), f"""
SELECT symbol, {q.at('ts')} AS ts, {r('gap_pct')} AS gap_pct, {r('rel_vol')} AS rel_vol,
  {r('gap_pct * rel_vol')} AS strength FROM ind WHERE gap_pct >= 0.05 AND rel_vol >= 2.5"""))
def gap_events(spark, sf_dir):
    return feat.gap_events(t.frame(spark, sf_dir)).select("symbol", when("ts"), num("gap_pct"), num("rel_vol"), num("strength"))


@query("post_gap_window", q.with_((q.BARS, q.IND, q.MOVES, q.PIVOTS, q.EP), f"""
SELECT symbol, year, {q.at('ts')} AS gap_date, post_bars, {r('post_range')} AS post_range, held,
  {r('gap_fill')} AS gap_fill, {r('post_pos')} AS close_pos FROM ep WHERE rn IS NOT NULL"""))
def post_gap_window(spark, sf_dir):
    df = t.move_features(spark, sf_dir).filter(F.col("ep").isNotNull())
    return df.select("symbol", "year", when("ep.ts", "gap_date"), whole("ep.post_bars", "post_bars"),
                     num("ep.post_range", "post_range"), F.col("ep.held").alias("held"), num("ep.gap_fill", "gap_fill"),
                     num("ep.close_pos", "close_pos"))


@query("pole_gain", q.with_((q.BARS, q.IND, q.MOVES, q.PIVOTS, q.BASE, q.POLE), f"""
SELECT symbol, year, pole_len::INT AS pole_len, {r('pole_gain')} AS pole_gain, {r('pole_volume')} AS pole_volume FROM pole"""))
def pole_gain(spark, sf_dir):
    return t.move_features(spark, sf_dir).select(
        "symbol", "year", (-F.col("pole.o")).cast("int").alias("pole_len"),
        num(F.coalesce("pole.gain", F.lit(0.0)), "pole_gain"), num("pole.volume", "pole_volume"))


@query("cup_edge", q.with_((q.BARS, q.IND, q.MOVES, q.PIVOTS, q.BASE, q.CUP), f"""
SELECT symbol, year, {q.at('edge_date')} AS edge_date, cup_days, cup_high, cup_low, bottom_bars, {r('edge_gain')} AS edge_gain
FROM cup WHERE rn_edge IS NOT NULL"""))
def cup_edge(spark, sf_dir):
    df = t.move_features(spark, sf_dir).filter(F.col("rn_edge").isNotNull())
    return df.select("symbol", "year", when("edge_date"), whole("cup_days"), "cup_high", "cup_low",
                     whole("cup_bottom_bars", "bottom_bars"), num("edge_prior_gain", "edge_gain"))


@query("double_lows", q.with_((q.BARS, q.IND, q.SWINGS, q.MOVES, q.PIVOTS, q.WAVE), f"""
SELECT symbol, year, {q.at('ts1')} AS low1_date, price1 AS low1, {q.at('ts2')} AS low2_date, price2 AS low2, peak,
  {r('gain1')} AS low1_gain FROM wave"""))
def double_lows(spark, sf_dir):
    return t.move_features(spark, sf_dir).select(
        "symbol", "year", when("low1.ts", "low1_date"), F.col("low1.price").alias("low1"), when("low2.ts", "low2_date"),
        F.col("low2.price").alias("low2"), F.col("peak.price").alias("peak"), num("low1_prior_gain", "low1_gain"))


@query("pocket_features", q.with_((q.BARS, q.EMA, q.IND, q.MOVES, q.PIVOTS, q.PP), f"""
SELECT symbol, year, {r('ema10')} AS ema10, {r('sma200')} AS sma200, {r('sma50_back')} AS sma50_back, down_vol, down_days FROM pp"""))
def pocket_features(spark, sf_dir):
    return t.move_features(spark, sf_dir).select(
        "symbol", "year", num("p_ema10", "ema10"), num("p_sma200", "sma200"), num("p_sma50_back", "sma50_back"),
        F.coalesce("p_max_down_vol", F.lit(0.0)).alias("down_vol"), whole("p_n_down_days", "down_days"))


def detector_query(setup: str):
    def run(spark, sf_dir):
        found = detect(t.move_features(spark, sf_dir), setup)
        return found.select("symbol", "year", F.col("result.setup").alias("setup"), F.col("result.score").alias("score"),
                            F.col("result.matched").alias("matched"), criteria_text().alias("criteria"))
    return run


TO_FEATURES = (q.BARS, q.EMA, q.IND, q.SWINGS, q.MOVES, q.PIVOTS, *q.ALL_FEATURES)
for _name, _setup in {
    "setup_vcp": "VCP", "setup_flat_base": "Flat Base", "setup_cup_with_handle": "Cup with Handle",
    "setup_double_bottom": "Double Bottom", "setup_high_tight_flag": "HTF", "setup_pocket_pivot": "Pocket Pivot",
    "setup_episodic_pivot": "Episodic Pivot", "setup_gap_and_go": "Gap & Go",
}.items():
    query(_name, q.with_(TO_FEATURES, q.detector(_setup)))(detector_query(_setup))


@query("criteria_counts", q.with_((*TO_FEATURES, q.DETECTED), """
SELECT setup, split_part(c, '=', 1) AS criterion, split_part(c, '=', 2) AS met, count(*) AS n
FROM (SELECT setup, unnest(string_split(rtrim(criteria, ';'), ';')) AS c FROM detected) GROUP BY ALL"""))
def criteria_counts(spark, sf_dir):
    """How often each criterion was met or failed: why the detectors choose as they do."""
    results = detect_all(t.move_features(spark, sf_dir)).select(F.explode("results").alias("r"))
    rows = results.select("r.setup", F.explode("r.criteria").alias("c"))
    return rows.groupBy("setup", F.col("c.name").alias("criterion"), F.col("c.met").cast("string").alias("met")).agg(
        F.count(F.lit(1)).alias("n"))


@query("detector_registry", q.with_((*TO_FEATURES, q.DETECTED), """
SELECT setup, count(*) AS moves, sum(matched::INT)::BIGINT AS matched, sum(score)::BIGINT AS score FROM detected GROUP BY setup
UNION ALL SELECT 'Broken', count(*), 0, 0 FROM pivots HAVING count(*) > 0"""))
def detector_registry(spark, sf_dir):
    """All detectors plus a registered one that cannot be resolved: it never stops the others."""
    table = register("Broken", lambda: F.col("no_such_column"))
    results = detect_all(t.move_features(spark, sf_dir), table).select(F.explode("results").alias("r"))
    return results.groupBy("r.setup").agg(
        F.count(F.lit(1)).alias("moves"), F.sum(F.col("r.matched").cast("int")).alias("matched"),
        F.sum("r.score").alias("score"))


def classified(spark, sf_dir):
    def build():
        resolved = resolve.resolve(detect_all(t.move_features(spark, sf_dir)))
        return resolve.classify(t.moves(spark, sf_dir), t.bars(spark, sf_dir), t.pivot_table(spark, sf_dir), resolved)
    return t.staged(spark, sf_dir, "classified", build)


@query("primary_setup", q.with_(q.TO_CLASSIFIED, "SELECT symbol, year, ai_primary, needs_review FROM resolved"))
def primary_setup(spark, sf_dir):
    resolved = resolve.resolve(detect_all(t.move_features(spark, sf_dir)))
    return resolved.select("symbol", "year", F.col("primary").alias("ai_primary"), "needs_review")


CLASSIFIED_COLUMNS = ("move_key", "ai_primary", "needs_review", "reason")


@query("classify_moves", q.with_(q.TO_CLASSIFIED, f"SELECT {', '.join(CLASSIFIED_COLUMNS)} FROM classified"))
def classify_moves(spark, sf_dir):
    resolved = resolve.resolve(detect_all(feat.move_features(t.pivot_table(spark, sf_dir), t.frame(spark, sf_dir))))
    done = resolve.classify(t.moves(spark, sf_dir), t.bars(spark, sf_dir), t.pivot_table(spark, sf_dir), resolved)
    return done.select(*CLASSIFIED_COLUMNS)


@query("run_counters", q.with_(
    q.TO_CLASSIFIED, "SELECT coalesce(reason, 'ok') AS outcome, count(*) AS n FROM classified GROUP BY ALL"))
def run_counters(spark, sf_dir):
    return resolve.run_counters(classified(spark, sf_dir))


@query("primary_distribution", q.with_(
    q.TO_CLASSIFIED, "SELECT coalesce(ai_primary, '(none)') AS setup, count(*) AS n FROM classified GROUP BY ALL"))
def primary_distribution(spark, sf_dir):
    return resolve.primary_distribution(classified(spark, sf_dir))


# An earlier run: the best setups were seen by a person, and one move is no longer in the table.
PRIOR = """
prior AS MATERIALIZED (
  SELECT move_key, 'VCP' AS ai_primary, false AS needs_review, 'old' AS reason, 'Flat Base' AS user_primary, 'seen' AS user_note
  FROM classified WHERE top >= 60
  UNION ALL SELECT DISTINCT symbol || '_1999', NULL, true, 'old', NULL, 'gone' FROM classified
)"""


def prior_records(spark, sf_dir):
    done = classified(spark, sf_dir)
    top = F.array_max(F.transform("ai_all_detector_results", lambda x: x["score"]))
    seen = done.filter(top >= 60).select(
        "move_key", F.lit("VCP").alias("ai_primary"), F.lit(False).alias("needs_review"), F.lit("old").alias("reason"),
        F.lit("Flat Base").alias("user_primary"), F.lit("seen").alias("user_note"))
    gone = done.select(F.concat("symbol", F.lit("_1999")).alias("move_key")).distinct().select(
        "move_key", F.lit(None).cast("string").alias("ai_primary"), F.lit(True).alias("needs_review"),
        F.lit("old").alias("reason"), F.lit(None).cast("string").alias("user_primary"), F.lit("gone").alias("user_note"))
    return seen.unionByName(gone)


@query("merge_classifications", q.with_((*q.TO_CLASSIFIED, PRIOR), """
SELECT coalesce(c.move_key, p.move_key) AS move_key,
  CASE WHEN c.move_key IS NOT NULL THEN c.ai_primary ELSE p.ai_primary END AS ai_primary,
  CASE WHEN c.move_key IS NOT NULL THEN c.needs_review ELSE p.needs_review END AS needs_review,
  CASE WHEN c.move_key IS NOT NULL THEN c.reason ELSE p.reason END AS reason, p.user_primary, p.user_note
FROM classified c FULL JOIN prior p ON p.move_key = c.move_key"""))
def merge_classifications(spark, sf_dir):
    merged = tables.merge_classifications(
        classified(spark, sf_dir).select(*CLASSIFIED_COLUMNS), prior_records(spark, sf_dir))
    return merged.select(*CLASSIFIED_COLUMNS, "user_primary", "user_note")


# Corrections: every unmatched move is named by hand, some twice, and one key is new.
OVERRIDES = """
overrides AS MATERIALIZED (
  SELECT move_key, TIMESTAMP '2024-02-01' AS saved_at, 'VCP' AS user_primary, 'first' AS user_note FROM classified WHERE ai_primary IS NULL
  UNION ALL SELECT move_key, TIMESTAMP '2024-02-02', 'HTF', NULL FROM classified WHERE ai_primary IS NULL AND reason IS NOT NULL
  UNION ALL SELECT DISTINCT symbol || '_1', TIMESTAMP '2024-02-03', NULL, 'new' FROM classified
)"""


def overrides(spark, sf_dir):
    done = classified(spark, sf_dir)
    none = done.filter(F.col("ai_primary").isNull())

    def rows(df, key, at, primary, note):
        return df.select(key.alias("move_key"), F.to_timestamp(F.lit(at)).alias("saved_at"),
                         F.lit(primary).cast("string").alias("user_primary"), F.lit(None).cast("string").alias("user_secondary"),
                         F.lit(note).cast("string").alias("user_note"))
    key = F.col("move_key")
    return (
        rows(none, key, "2024-02-01 00:00:00", "VCP", "first")
        .unionByName(rows(none.filter(F.col("reason").isNotNull()), key, "2024-02-02 00:00:00", "HTF", None))
        .unionByName(rows(done.select("symbol").distinct(), F.concat("symbol", F.lit("_1")), "2024-02-03 00:00:00", None, "new"))
    )


@query("apply_overrides", q.with_((*q.TO_CLASSIFIED, OVERRIDES), """
SELECT coalesce(c.move_key, o.move_key) AS move_key, c.ai_primary, o.user_primary, o.user_note,
  CASE WHEN o.move_key IS NOT NULL THEN true END AS user_reviewed, o.user_reviewed_at
FROM classified c FULL JOIN (
  SELECT move_key, last(user_primary ORDER BY saved_at) AS user_primary,
    last(user_note ORDER BY saved_at) FILTER (user_note IS NOT NULL) AS user_note, strftime(max(saved_at), '%Y-%m-%d') AS user_reviewed_at
  FROM overrides GROUP BY move_key) o ON o.move_key = c.move_key"""))
def apply_overrides(spark, sf_dir):
    done = tables.apply_overrides(classified(spark, sf_dir).select(*CLASSIFIED_COLUMNS), overrides(spark, sf_dir))
    return done.select("move_key", "ai_primary", "user_primary", "user_note", "user_reviewed",
                       F.col("user_reviewed_at").cast("string").alias("user_reviewed_at"))


# Updates: large moves are doubled, and every symbol gets a row for a year it lacks.
UPDATES = """
updates AS (
  SELECT symbol, year, gain_pct * 2 AS gain_pct FROM moves WHERE gain_pct >= 40
  UNION ALL SELECT DISTINCT symbol, 1, 0.0::DOUBLE FROM moves
)"""


def updates(spark, sf_dir):
    base = t.moves(spark, sf_dir).select("symbol", "year", "gain_pct")
    return base.filter(F.col("gain_pct") >= 40).withColumn("gain_pct", F.col("gain_pct") * 2).unionByName(
        base.select("symbol").distinct().select("symbol", F.lit(1).alias("year"), F.lit(0.0).alias("gain_pct")))


@query("upsert_moves", q.with_((q.BARS, q.MOVES, UPDATES), f"""
SELECT symbol, year, {r('gain_pct')} AS gain_pct, {q.at('low_date')} AS low_date FROM moves m
  WHERE NOT EXISTS (SELECT 1 FROM updates u WHERE u.symbol = m.symbol AND u.year = m.year)
UNION ALL SELECT u.symbol, u.year, {r('u.gain_pct')}, {q.at('m.low_date')} FROM updates u LEFT JOIN moves m USING (symbol, year)"""))
def upsert_moves(spark, sf_dir):
    moves = t.moves(spark, sf_dir).select("symbol", "year", "gain_pct", "low_date")
    done = tables.upsert_moves(moves, updates(spark, sf_dir))
    return done.select("symbol", "year", num("gain_pct"), when("low_date"))


@query("remove_moves", q.with_((q.BARS, q.MOVES), f"SELECT symbol, year, {r('gain_pct')} AS gain_pct FROM moves WHERE NOT gain_pct >= 40"))
def remove_moves(spark, sf_dir):
    moves = t.moves(spark, sf_dir)
    gone = moves.filter(F.col("gain_pct") >= 40).select("symbol", "year")
    return tables.remove_moves(moves, gone).select("symbol", "year", num("gain_pct"))


@query("remove_bars", q.with_((q.BARS, q.MOVES), f"""
SELECT symbol, {q.at('ts')} AS ts, close FROM bars
WHERE symbol NOT IN (SELECT symbol FROM moves WHERE gain_pct >= 60)"""))
def remove_bars(spark, sf_dir):
    gone = t.moves(spark, sf_dir).filter(F.col("gain_pct") >= 60).select("symbol", "year", F.lit(True).alias("delete_bars"))
    return tables.remove_bars(t.bars(spark, sf_dir), gone).select("symbol", when("ts"), "close")


# The feed covers the last two years again with other prices, sent twice, and a symbol that is new.
def existing_and_feed(spark, sf_dir):
    bars = daily(spark, sf_dir)
    old = bars.filter((F.year("ts") < 2000) & (F.col("symbol") != "5-LOW"))
    new = bars.filter((F.year("ts") >= 1999) | (F.col("symbol") == "5-LOW")).withColumn("close", F.col("close") + 1).withColumn("seq", F.lit(2))
    stale = new.withColumn("close", F.lit(-5.0)).withColumn("seq", F.lit(3)).filter(F.dayofmonth("ts") == 1)
    first = new.withColumn("close", F.col("close") + 9).withColumn("seq", F.lit(1))
    return old, new.unionByName(first).unionByName(stale)


@query("extend_bars", q.with_([q.DAILY], f"""
SELECT symbol, {q.at('ts')} AS ts, {r('close')} AS close, volume FROM dbars WHERE year(ts) < 2000 AND symbol <> '5-LOW'
UNION ALL
SELECT d.symbol, {q.at('d.ts')}, {r('d.close + 1')}, d.volume FROM dbars d
WHERE year(d.ts) >= 1999 AND NOT EXISTS (
  SELECT 1 FROM dbars o WHERE o.symbol = d.symbol AND o.symbol <> '5-LOW' AND year(o.ts) < 2000 AND o.ts >= d.ts)"""
).replace("WHERE year(d.ts) >= 1999 AND NOT", "WHERE (year(d.ts) >= 1999 OR d.symbol = '5-LOW') AND NOT"))
def extend_bars(spark, sf_dir):
    old, feed = existing_and_feed(spark, sf_dir)
    return tables.extend_bars(old, feed).select("symbol", when("ts"), num("close"), "volume")


@query("fill_bars", q.with_([q.DAILY], f"""
SELECT symbol, {q.at('ts')} AS ts, {r('close')} AS close FROM dbars WHERE year(ts) = 1998
UNION ALL SELECT symbol, {q.at('ts')}, {r('close + 1')} FROM dbars WHERE year(ts) <> 1998"""))
def fill_bars(spark, sf_dir):
    bars = daily(spark, sf_dir)
    have = bars.filter(F.year("ts") == 1998)
    feed = bars.withColumn("close", F.col("close") + 1).withColumn("seq", F.lit(1))
    return tables.fill_bars(have, feed).select("symbol", when("ts"), num("close"))


@query("range_summary", q.with_([q.DAILY], f"""
SELECT symbol, {q.at('arg_min(ts, (close, ts))')} AS low_date, {q.at('arg_min(ts, (-close, ts))')} AS high_date,
  min(close) AS low_price, max(close) AS high_price, {r('(max(close) / min(close) - 1) * 100')} AS gain_pct,
  {r('avg(volume)')} AS avg_vol, count(*) AS total_bars FROM dbars GROUP BY symbol"""))
def range_summary(spark, sf_dir):
    return tables.range_summary(daily(spark, sf_dir)).select(
        "symbol", when("low_date"), when("high_date"), "low_price", "high_price", num("gain_pct"),
        num(F.col("avg_vol_b") * 1e9, "avg_vol"), "total_bars")

"""Quality of a move: trend, pain, gaps, streaks and the screens built on them.

Most functions take ``inside``, the output of ``move_bars`` over the indicator
frame; stage it once when several of them are wanted.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.functions.flags import flag
from tidebars.series import CHUNK, MOVE_KEY, Running, bars_at, running, span_bars

TOUCH_BAND = 0.03
UNDERWATER = -0.10
GAP_PCT, GAP_REL_VOL = 5.0, 1.5
REAL_ABOVE, TRAP_BELOW = 70.0, 30.0
LABELS = ("REAL", "MID", "TRAP")
STAT_COLUMNS = ("ema10_pct", "ema20_pct", "sma50_touches", "days_below_50", "worst_dd_pct", "days_u10", "pct_u10", "adr")


def pct(condition: Column) -> Column:
    """Share of rows, in percent, where the condition is true (null counts as false)."""
    return F.avg(F.when(condition, 100.0).otherwise(0.0))


def window_stats(inside: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Trend and pain measures per move, or per slice of a move with ``by``.

    The drawdown is from the running maximum of closes, which restarts with each group; it is null while that is zero.
    """
    keys = [*MOVE_KEY, *by]
    columns = ["chunk", "rn", "ts", "close", "high", "low", "ema10", "ema20", "sma50", "adr_pct_20"]
    ran = running(inside.select(*keys, *columns), keys, [Running("top", "max", F.col("close"))])
    drop = F.try_divide(F.col("low") - F.col("top"), F.col("top"))
    off_50 = F.try_divide(F.abs(F.col("close") - F.col("sma50")), F.col("sma50"))
    first, last = F.min(F.struct("rn", "close", "ts")), F.max(F.struct("rn", "close", "ts"))
    return ran.withColumn("drop", drop).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"),
        pct(F.col("close") >= F.col("ema10")).alias("ema10_pct"),
        pct(F.col("close") >= F.col("ema20")).alias("ema20_pct"),
        F.count(F.when(off_50 < TOUCH_BAND, 1)).alias("sma50_touches"),
        F.count(F.when(F.col("close") < F.col("sma50"), 1)).alias("days_below_50"),
        (F.min("drop") * 100.0).alias("worst_dd_pct"),
        F.count(F.when(F.col("drop") < UNDERWATER, 1)).alias("days_u10"),
        pct(F.col("drop") < UNDERWATER).alias("pct_u10"),
        F.avg("adr_pct_20").alias("adr"),
        first.getField("close").alias("px_start"), last.getField("close").alias("px_end"),
        F.min("low").alias("low"), F.max("high").alias("high"),
        first.getField("ts").alias("first_ts"), last.getField("ts").alias("last_ts"),
    )


def quarter_of(pos: Column, n: Column) -> Column:
    """Quarter 1 to 4 of a move by row position; the cuts are n//4, n//2 and 3n//4."""
    cut = [F.floor(n / F.lit(4)), F.floor(n / F.lit(2)), F.floor(3 * n / F.lit(4))]
    return F.when(pos < cut[0], 1).when(pos < cut[1], 2).when(pos < cut[2], 3).otherwise(4)


def quarter_stats(inside: DataFrame) -> DataFrame:
    """``window_stats`` of the four quarters of each move; empty quarters are absent."""
    sliced = inside.withColumn("quarter", quarter_of(F.col("pos"), F.col("n_bars")))
    return window_stats(sliced, by=["quarter"])


def gap_scan(inside: DataFrame) -> DataFrame:
    """Opening gaps on volume inside each move, labelled by where the bar closed.

    Both the previous close and the 20-bar mean volume have to lie inside the move.
    """
    gap_pct = F.when((F.col("pos") > 0) & (F.col("prev_close") > 0),
                     (F.col("open") - F.col("prev_close")) / F.col("prev_close") * 100.0)
    rel = F.when(F.col("pos") >= 19, F.try_divide("volume", "vol_mean_20"))
    close_pct = F.coalesce(F.col("close_pos") * 100.0, F.lit(50.0))
    label = F.when(F.col("close_pct") > REAL_ABOVE, "REAL").when(F.col("close_pct") < TRAP_BELOW, "TRAP").otherwise("MID")
    return (
        inside.select(*MOVE_KEY, "rn", "ts", "low", gap_pct.alias("gap_pct"), rel.alias("rel_vol_20"),
                      close_pct.alias("close_pct"))
        .filter((F.col("gap_pct") >= GAP_PCT) & (F.col("rel_vol_20") >= GAP_REL_VOL))
        .withColumn("label", label)
    )


def longest_streak(inside: DataFrame) -> DataFrame:
    """Longest run of closes at or above ema10 per move, the first of the longest."""
    above = flag(F.col("close") >= F.col("ema10"))
    marked = inside.select(*MOVE_KEY, "chunk", "rn", "ts", above.alias("above"))
    runs = running(marked, list(MOVE_KEY), [Running("breaks", "sum", F.when(F.col("above"), 0).otherwise(1))])
    islands = runs.filter("above").groupBy(*MOVE_KEY, "breaks").agg(
        F.count(F.lit(1)).alias("len"), F.min(F.struct("rn", "ts")).alias("s"), F.max(F.struct("rn", "ts")).alias("e")
    )
    best = F.max(F.struct("len", (-F.col("s.rn")).alias("o"), F.col("s.ts").alias("s"), F.col("e.ts").alias("e")))
    return islands.groupBy(*MOVE_KEY).agg(best.alias("b")).select(
        *MOVE_KEY, F.col("b.s").alias("streak_start"), F.col("b.e").alias("streak_end"),
        F.col("b.len").alias("streak_days"), F.floor(F.col("b.len") / F.lit(5)).alias("streak_weeks"),
    )


def move_lookup(moves: DataFrame, symbol: str, year: int) -> DataFrame:
    return moves.filter((F.col("symbol") == symbol) & (F.col("year") == year))


def trend_slope(inside: DataFrame) -> DataFrame:
    """Least-squares slope of the close per bar, and in percent of the first close."""
    slope = F.regr_slope(F.col("close"), F.col("pos").cast("double"))
    first = F.min(F.struct("rn", "close")).getField("close")
    return inside.groupBy(*MOVE_KEY).agg(slope.alias("slope"), first.alias("first_close")).select(
        *MOVE_KEY, "slope", (F.try_divide("slope", "first_close") * 100.0).alias("slope_pct")
    )


def swing_legs(swing_table: DataFrame) -> DataFrame:
    """Each swing high with the swing lows before and after it.

    Swings alternate: the run of lows before a high ends where the high's run begins.
    """
    lows = swing_table.filter(F.col("kind") == "low")
    before = lows.select("symbol", F.col("last_rn").alias("after_rn"), F.col("rn").alias("rn_before"),
                         F.col("price").alias("low_before"))
    after = lows.select("symbol", F.col("after_rn").alias("last_rn"), F.col("rn").alias("rn_after"),
                        F.col("price").alias("low_after"))
    highs = swing_table.filter(F.col("kind") == "high")
    return highs.join(before, ["symbol", "after_rn"]).join(after, ["symbol", "last_rn"])


def retracements(located: DataFrame, swing_table: DataFrame, chunk_rows: int = CHUNK) -> DataFrame:
    """Pullback as a share of the advance before it, per swing high inside a move."""
    legs = swing_legs(swing_table)
    spans = located.select(*MOVE_KEY, "rn_lo", "rn_hi")
    inside = span_bars(spans, legs, "rn_lo", "rn_hi", chunk_rows).filter(
        (F.col("rn_before") >= F.col("rn_lo")) & (F.col("rn_after") <= F.col("rn_hi"))
    )
    rise = F.col("price") - F.col("low_before")
    ratio = F.when(rise > 0, (F.col("price") - F.col("low_after")) / rise)
    return inside.select(*MOVE_KEY, "rn", "ts", ratio.alias("retracement"))


def retracement_summary(ratios: DataFrame) -> DataFrame:
    """Worst and mean retracement per move; below half is fine, above 60% is rejected."""
    verdict = F.when(F.col("worst") < 0.5, "fine").when(F.col("worst") > 0.6, "rejected").otherwise("borderline")
    return ratios.groupBy(*MOVE_KEY).agg(
        F.count("retracement").alias("pullbacks"), F.max("retracement").alias("worst"),
        F.avg("retracement").alias("mean"),
    ).withColumn("verdict", verdict)


def gap_labels(gaps: DataFrame) -> DataFrame:
    """Number of gaps per label and move, and the share that closed well."""
    counted = gaps.groupBy(*MOVE_KEY).pivot("label", list(LABELS)).agg(F.count(F.lit(1)))
    filled = counted.na.fill(0, list(LABELS)).withColumnsRenamed({x: x.lower() for x in LABELS})
    return filled.withColumn("hit_rate", F.try_divide("real", F.col("real") + F.col("mid") + F.col("trap")))


def quick_screen(stats: DataFrame, gaps: DataFrame, streaks: DataFrame) -> DataFrame:
    """Five yes/no filters per move; two or more misses mean skip."""
    good_gap = gaps.groupBy(*MOVE_KEY).agg(F.max("close_pct").alias("best_close_pct"))
    joined = stats.join(good_gap, list(MOVE_KEY), "left").join(streaks, list(MOVE_KEY), "left")
    checks = {
        "trend_ok": flag(F.col("ema10_pct") >= 70),
        "touches_ok": flag(F.col("sma50_touches") < 10),
        "adr_ok": flag(F.col("adr") < 7),
        "gap_ok": flag(F.col("best_close_pct") > 70),
        "streak_ok": flag(F.col("streak_weeks") >= 8),
    }
    misses = sum((F.when(c, 0).otherwise(1) for c in checks.values()), F.lit(0))
    verdict = F.when(F.col("misses") == 0, "pass").when(F.col("misses") >= 2, "skip").otherwise("review")
    return joined.select(*MOVE_KEY, *[c.alias(n) for n, c in checks.items()], misses.alias("misses")).withColumn(
        "screen", verdict)


def metrics_by_verdict(stats: DataFrame, verdicts: DataFrame, columns: Sequence[str] = STAT_COLUMNS) -> DataFrame:
    """Mean and range of the measures per verdict; the row with a null verdict is the total."""
    measures = [
        f(c).alias(f"{n}_{c}") for c in columns for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))
    ]
    joined = stats.join(verdicts.select(*MOVE_KEY, "verdict"), list(MOVE_KEY))
    return joined.rollup("verdict").agg(F.count(F.lit(1)).alias("moves"), *measures)


def gain_correlation(moves: DataFrame, stats: DataFrame, columns: Sequence[str] = STAT_COLUMNS) -> DataFrame:
    """Correlation of the gain with each quality measure."""
    joined = moves.select(*MOVE_KEY, "gain_pct").join(stats, list(MOVE_KEY))
    return joined.agg(F.count(F.lit(1)).alias("moves"), *[F.corr("gain_pct", F.col(c).cast("double")).alias(c)
                                                       for c in columns])


# Tag spellings people use for the detectors' setup names.
TAG_SYNONYMS = {
    "EP": "Episodic Pivot",
    "Episodic Pivot": "Episodic Pivot",
    "VCP": "VCP",
    "Cup & Handle": "Cup with Handle",
    "Cup and Handle Breakout": "Cup with Handle",
    "Cup with Handle": "Cup with Handle",
    "Flat Base": "Flat Base",
    "Double Bottom": "Double Bottom",
    "HTF": "HTF",
    "Pocket Pivot": "Pocket Pivot",
    "Gap & Go": "Gap & Go",
    "Gap and Go": "Gap & Go",
}


def canonical_tags(tags: Column) -> Column:
    """Tags as setup names; tags that name no setup are dropped."""
    table = F.create_map(*[F.lit(x) for pair in TAG_SYNONYMS.items() for x in pair])
    return F.array_distinct(F.array_compact(F.transform(tags, lambda t: F.try_element_at(table, t))))


def agreement(classified: DataFrame, human: DataFrame) -> DataFrame:
    """Machine against human per move: the override if there is one, else any of the tags."""
    joined = classified.select(*MOVE_KEY, "ai_primary").join(
        human.select(*MOVE_KEY, "tags", "user_primary"), list(MOVE_KEY))
    named = F.when(F.col("user_primary").isNotNull(), F.array("user_primary")).otherwise(F.col("tags"))
    setups = canonical_tags(F.coalesce(named, F.array().cast("array<string>")))
    agrees = F.when(F.size("human") == 0, F.col("ai_primary").isNull()).otherwise(
        F.coalesce(F.array_contains("human", F.col("ai_primary")), F.lit(False)))
    return joined.withColumn("human", setups).withColumn("agrees", agrees).select(
        *MOVE_KEY, "ai_primary", "human", "agrees")


def confusion(agreed: DataFrame) -> DataFrame:
    """Counts of (machine setup, human setup) pairs."""
    pairs = agreed.select(
        F.coalesce("ai_primary", F.lit("(none)")).alias("machine"), F.explode_outer("human").alias("h"), "agrees"
    )
    return pairs.groupBy("machine", F.coalesce("h", F.lit("(none)")).alias("human")).agg(F.count(F.lit(1)).alias("n"))


# Grades from best to worst.
GRADES = ("A", "B", "C", "D", "E")


def library_view(library: DataFrame, tag: str | None = None, direction: str | None = None,
                 min_rating: str | None = None, min_gain: float | None = None,
                 symbols: Sequence[str] | None = None, year: int | None = None,
                 primary: str | None = None) -> DataFrame:
    """Annotated moves under any combination of filters; a filter left out keeps everything."""
    out = library
    if tag is not None:
        out = out.filter(F.array_contains("tags", tag))
    if direction is not None:
        out = out.filter(F.col("direction") == direction)
    if min_rating is not None:
        out = out.filter(F.col("rating").isin(*GRADES[:GRADES.index(min_rating) + 1]))
    if min_gain is not None:
        out = out.filter(F.col("gain_pct") >= min_gain)
    if symbols is not None:
        out = out.filter(F.col("symbol").isin(*symbols))
    if year is not None:
        out = out.filter(F.col("year") == year)
    if primary is not None:
        out = out.filter(F.col("ai_primary") == primary)
    return out


def tag_counts(annotations: DataFrame) -> DataFrame:
    return annotations.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def rename_tag(annotations: DataFrame, old: str, new: str) -> DataFrame:
    """Replace a tag everywhere; a row that already has the new tag keeps it once."""
    swapped = F.transform("tags", lambda t: F.when(t == old, F.lit(new)).otherwise(t))
    return annotations.withColumn("tags", F.array_distinct(swapped))


def delete_tag(annotations: DataFrame, tag: str) -> DataFrame:
    return annotations.withColumn("tags", F.array_remove("tags", tag))


def legs_of(reviews: DataFrame) -> DataFrame:
    """One row per leg of each reviewed move, in order."""
    legs = reviews.select("move_key", F.posexplode("legs").alias("i", "leg"))
    gain = F.regexp_extract(F.col("leg.pct_gain"), r"([-+]?[0-9]+(?:\.[0-9]+)?)", 1)
    answer = F.lower(F.trim(F.col("leg.tradable")))
    verdict = (
        F.when(answer == "true", "yes").when(answer == "false", "no").when(answer.startswith("partial"), "partial")
    )
    return legs.select(
        "move_key", F.col("leg.leg").alias("leg"), F.col("leg.of").alias("of"), F.col("leg.period").alias("period"),
        gain.try_cast("double").alias("gain_pct"), F.col("leg.setup").alias("setup"), verdict.alias("tradable"),
    )


def leg_rollup(legs: DataFrame) -> DataFrame:
    """Per move: legs, tradable legs, best and total gain."""
    return legs.groupBy("move_key").agg(
        F.count(F.lit(1)).alias("legs"),
        F.count(F.when(F.col("tradable") == "yes", 1)).alias("tradable_legs"),
        F.max("gain_pct").alias("best_gain_pct"),
        F.sum("gain_pct").alias("sum_gain_pct"),
    )


STOP_DISTANCE = 0.08


def stop_levels(pivot_table: DataFrame, features: DataFrame, frame: DataFrame, chunk_rows: int = CHUNK) -> DataFrame:
    """Stops 8% below the base and, when there is a qualifying gap, 8% below the gap day's low."""
    base = pivot_table.select(*MOVE_KEY, "pivot_date", (F.col("base_low") * (1 - STOP_DISTANCE)).alias("base_stop"))
    gaps = features.selectExpr(*MOVE_KEY, "-ep.o AS rn_gap", "ep.ts AS gap_date").filter("rn_gap IS NOT NULL")
    lows = bars_at(gaps, frame, {"gap": "rn_gap"}, ["low"], chunk_rows=chunk_rows)
    stops = lows.select(*MOVE_KEY, "gap_date", (F.col("gap_low") * (1 - STOP_DISTANCE)).alias("gap_stop"))
    return base.join(stops, list(MOVE_KEY), "left")

"""Tables that grow: moves, bars, classifications, reviews and annotations.

Each function returns the new version of a table; write it to a new place, never
over the files it was read from.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

USER_COLUMNS = ("user_primary", "user_secondary", "user_note", "user_reviewed", "user_reviewed_at")


def latest(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key, found without bringing the rows of a key together."""
    rest = [c for c in df.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*key).agg(last.alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])


def merge_classifications(fresh: DataFrame, prior: DataFrame | None) -> DataFrame:
    """New records over old ones: keys that were not run again and all ``user_*`` values stay."""
    if prior is None:
        return fresh
    computed = [c for c in fresh.columns if c != "move_key" and c not in USER_COLUMNS]
    users = [c for c in prior.columns if c in USER_COLUMNS]
    others = [c for c in prior.columns if c not in fresh.columns and c not in USER_COLUMNS]
    new = fresh.select("move_key", F.struct(*computed).alias("new"))
    old = prior.select("move_key", F.struct(*[c for c in computed if c in prior.columns]).alias("old"), *others, *users)
    joined = new.join(old, "move_key", "full_outer")
    held = set(prior.columns)
    return joined.select(
        "move_key",
        *[
            (F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")) if c in held
             else F.col(f"new.{c}")).alias(c)
            for c in computed
        ],
        *others, *users,
    )


def apply_overrides(classified: DataFrame, overrides: DataFrame) -> DataFrame:
    """Human corrections per key, in the order of ``saved_at``; unknown keys become new records.

    ``user_primary`` is always replaced by the last one; a null secondary or note means
    "not given" and leaves the earlier value.
    """
    def last_given(c: str) -> Column:
        return F.max(F.when(F.col(c).isNotNull(), F.struct("saved_at", c))).getField(c).alias(c)

    final = overrides.groupBy("move_key").agg(
        F.max(F.struct("saved_at", "user_primary")).getField("user_primary").alias("user_primary"),
        last_given("user_secondary"), last_given("user_note"),
        F.max("saved_at").cast("date").alias("user_reviewed_at"), F.lit(True).alias("user_reviewed"),
    )
    base = classified
    for c, kind in (("user_primary", "string"), ("user_secondary", "string"), ("user_note", "string"),
                    ("user_reviewed", "boolean"), ("user_reviewed_at", "date")):
        if c not in base.columns:
            base = base.withColumn(c, F.lit(None).cast(kind))
    o = final.select("move_key", F.struct(*[c for c in final.columns if c != "move_key"]).alias("o"))
    joined = base.join(o, "move_key", "full_outer")
    hit = F.col("o").isNotNull()
    replaced = {
        "user_primary": F.when(hit, F.col("o.user_primary")).otherwise(F.col("user_primary")),
        **{c: F.coalesce(F.col(f"o.{c}"), F.col(c)) for c in USER_COLUMNS if c != "user_primary"},
    }
    return joined.withColumns(replaced).drop("o")


def upsert(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows replace those of the same key and are added otherwise."""
    kept = table.join(rows.select(*key).distinct(), list(key), "left_anti").select(*table.columns)
    return kept.unionByName(rows, allowMissingColumns=True)


def upsert_moves(moves: DataFrame, rows: DataFrame) -> DataFrame:
    """Add or update moves on (symbol, year); columns the new rows lack keep their old value.

    Of several rows for one key the last by ``saved_at`` counts; without that column the one with the largest values.
    """
    key = ["symbol", "year"]
    rows = latest(rows, key, ["saved_at"] if "saved_at" in rows.columns else [c for c in rows.columns if c not in key])
    if "saved_at" not in moves.columns:
        rows = rows.drop("saved_at")
    extra = [c for c in moves.columns if c not in rows.columns]
    if extra:
        rows = rows.join(moves.select(*key, *extra), key, "left")
    return upsert(moves, rows.select(*moves.columns), key)


def remove_moves(moves: DataFrame, removals: DataFrame) -> DataFrame:
    return moves.join(removals.select("symbol", "year"), ["symbol", "year"], "left_anti").select(*moves.columns)


def remove_bars(bars: DataFrame, removals: DataFrame) -> DataFrame:
    """Bars without those of the symbols whose removal asks for it (``delete_bars``)."""
    gone = removals.filter(F.col("delete_bars")).select("symbol").distinct()
    return bars.join(gone, "symbol", "left_anti").select(*bars.columns)


BAR_COLUMNS = ("symbol", "ts", "open", "high", "low", "close", "volume")


def clean_feed(feed: DataFrame, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Complete bars with a positive close, one per (symbol, ts); the last one sent wins.

    ``order`` names the columns that tell which row was sent last.
    """
    missing = [c for c in order if c not in feed.columns]
    if missing:
        raise ValueError(f"the feed has no {', '.join(missing)} to tell which bar was sent last")
    whole = feed.dropna(subset=["symbol", "ts", "open", "high", "low", "close"]).filter(F.col("close") > 0)
    whole = whole.withColumn("volume", F.coalesce("volume", F.lit(0.0)))
    return latest(whole, ["symbol", "ts"], order).select(*BAR_COLUMNS)


def unseen_bars(bars: DataFrame, feed: DataFrame, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Feed bars after the last one of their symbol; a new symbol takes all of them."""
    last = bars.groupBy("symbol").agg(F.max("ts").alias("last_ts"))
    joined = clean_feed(feed, order).join(last, "symbol", "left")
    return joined.filter(F.col("last_ts").isNull() | (F.col("ts") > F.col("last_ts"))).drop("last_ts")


def extend_bars(bars: DataFrame, feed: DataFrame, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Bars plus the unseen ones of the feed; existing bars are never changed."""
    return bars.select(*BAR_COLUMNS).unionByName(unseen_bars(bars, feed, order))


def absent_bars(bars: DataFrame, feed: DataFrame, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Feed bars of times that their symbol does not have yet."""
    return clean_feed(feed, order).join(bars.select("symbol", "ts"), ["symbol", "ts"], "left_anti")


def fill_bars(bars: DataFrame, feed: DataFrame, order: Sequence[str] = ("seq",)) -> DataFrame:
    """As ``extend_bars`` but on any missing time, also before the last bar."""
    return bars.select(*BAR_COLUMNS).unionByName(absent_bars(bars, feed, order))


def range_summary(bars: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Lowest and highest close with their first dates, gain and mean volume (in billions).

    The low may come after the high. Bars without a close are left out throughout.
    """
    known = bars.filter(F.col("close").isNotNull())
    # the earliest of the highest closes is the smallest (-close, ts)
    return known.groupBy(*by).agg(
        F.min(F.struct("close", "ts")).alias("lo"),
        F.min(F.struct((-F.col("close")).alias("c"), "ts")).alias("hi"),
        F.avg("volume").alias("avg_vol"), F.count(F.lit(1)).alias("total_bars"),
    ).select(
        *by, F.col("lo.ts").alias("low_date"), F.col("hi.ts").alias("high_date"),
        F.col("lo.close").alias("low_price"), (-F.col("hi.c")).alias("high_price"),
        F.when(F.col("lo.close") > 0, (-F.col("hi.c") / F.col("lo.close") - 1) * 100.0).otherwise(0.0).alias("gain_pct"),
        (F.col("avg_vol") / 1e9).alias("avg_vol_b"), "total_bars",
    )


def save_reviews(reviews: DataFrame, posted: DataFrame) -> DataFrame:
    """Reviews with the posted ones in place; the last post of a key wins."""
    last = latest(posted, ["move_key"], ["saved_at"]).drop("saved_at")
    return upsert(reviews, last, ["move_key"])


def save_annotations(annotations: DataFrame, posted: DataFrame, whole: bool = False) -> DataFrame:
    """Annotations with the posted rows in place, or replaced by them with ``whole``."""
    last = latest(posted, ["move_key"], ["saved_at"]).drop("saved_at")
    return last.select(*annotations.columns) if whole else upsert(annotations, last, ["move_key"])

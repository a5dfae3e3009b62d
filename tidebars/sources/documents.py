"""Annotations, reviews and classifications kept as JSON.

Two layouts are read. ``keyed``: one document, an object per move key, as a person's
study file holds it. ``lines``: one object per line with a ``move_key``, which splits
over tasks and is the layout to use when a table grows large.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The fields of the documents.
ANNOTATION = "direction string, notes string, rating string, tags array<string>"
REVIEW = (
    "reviewed_at string, gain_pct double, period string, "
    "snapshot struct<price_range:string, ema10_adherence_pct:double, ema20_adherence_pct:double, "
    "worst_drawdown_pct:double, days_over_10pct_underwater:double, sma50_touches:double, "
    "trend_slope_per_day:string, big_gaps:array<string>>, "
    "legs array<struct<leg:int, of:int, period:string, pct_gain:string, setup:string, entry:string, "
    "stop:string, tradable:string, rationale:string>>, "
    "style_fit struct<overall:string, best_leg:string, concern:string>, "
    "textbook_comparison string, myth_bust_notes string, "
    "ai_vs_user_comparison struct<ai_best_entry:string, user_best_entry:string, who_was_right:string, lesson:string>"
)
RESULT = (
    "struct<setup:string, matched:boolean, score:int, criteria_met:array<string>, "
    "criteria_failed:array<string>, extra:map<string,string>>"
)
CLASSIFICATION = (
    "pivot struct<pivot_date:string, base_start:string, base_end:string, base_depth_pct:double, "
    "breakout_rel_vol:double>, "
    f"ai_classifications array<{RESULT}>, ai_all_detector_results array<{RESULT}>, "
    "ai_primary string, needs_review boolean, reason string, user_primary string, user_secondary string, "
    "user_note string, user_reviewed boolean, user_reviewed_at string"
)


def keyed(spark: SparkSession, path: str, fields: str, under: str | None = None) -> DataFrame:
    """Rows of a document that maps move keys to objects, optionally below a member."""
    kind = T.MapType(T.StringType(), T.StructType.fromDDL(fields))
    document = T.StructType([T.StructField(under, kind)]) if under else kind
    text = spark.read.text(path, wholetext=True)
    parsed = F.from_json(F.regexp_replace("value", "^\ufeff", ""), document)
    items = parsed.getField(under) if under else parsed
    return text.select(F.explode(items).alias("move_key", "v")).select("move_key", "v.*")


def lines(spark: SparkSession, path: str, fields: str) -> DataFrame:
    return spark.read.schema(f"move_key string, {fields}").json(path)


def read_annotations(spark: SparkSession, path: str, layout: str = "keyed") -> DataFrame:
    """One row per annotated move: move_key, direction, notes, rating, tags."""
    return keyed(spark, path, ANNOTATION, "items") if layout == "keyed" else lines(spark, path, ANNOTATION)


def read_custom_tags(spark: SparkSession, path: str) -> DataFrame:
    """The tags a person added, from the keyed document."""
    text = spark.read.text(path, wholetext=True)
    parsed = F.from_json(F.regexp_replace("value", "^\ufeff", ""), "struct<customTags:array<string>>")
    return text.select(F.explode(parsed.getField("customTags")).alias("tag"))


def explode_tags(annotations: DataFrame) -> DataFrame:
    """One row per (move, tag); a move without tags keeps one row with a null tag."""
    return annotations.select("move_key", F.explode_outer("tags").alias("tag"))


def read_reviews(spark: SparkSession, path: str, layout: str = "keyed") -> DataFrame:
    """One row per review. ``tradable`` is text, since it may be true, false or a sentence."""
    return keyed(spark, path, REVIEW) if layout == "keyed" else lines(spark, path, REVIEW)


def review_of(reviews: DataFrame, move_key: str) -> DataFrame:
    return reviews.filter(F.col("move_key") == move_key)


def read_classifications(spark: SparkSession, path: str, layout: str = "keyed") -> DataFrame:
    return keyed(spark, path, CLASSIFICATION) if layout == "keyed" else lines(spark, path, CLASSIFICATION)


def explode_results(classifications: DataFrame, column: str = "ai_classifications") -> DataFrame:
    """One row per (move, detector result)."""
    return classifications.select("move_key", F.explode(column).alias("r")).select("move_key", "r.*")

"""From detector results to one primary setup per move."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.operators.setups import DETECTORS
from tidebars.operators.setups.rules import RESULT_TYPE
from tidebars.series import MOVE_KEY

# Fixed values: (winner, loser) pairs in the order they apply.
TIEBREAKS = (
    ("HTF", "VCP"),
    ("HTF", "Cup with Handle"),
    ("Cup with Handle", "VCP"),
    ("Flat Base", "VCP"),
    ("Episodic Pivot", "Gap & Go"),
)
# Primary only when nothing else is left.
DEMOTED = ("Pocket Pivot", "Gap & Go")
REVIEW_SCORE = 60
UNRESOLVED = "(none)"


def primary_setup(results: Column, names: Sequence[str] = tuple(DETECTORS)) -> Column:
    """Name of the winning setup, null when nothing matched.

    ``results`` is the array of results in the order of ``names``.
    """
    entry = {n: F.get(results, F.lit(i)) for i, n in enumerate(names)}
    live = {n: F.coalesce(entry[n]["matched"], F.lit(False)) for n in names}
    for winner, loser in TIEBREAKS:
        if winner in live and loser in live:
            live[loser] = live[loser] & ~live[winner]
    strong = F.lit(False)
    for n in names:
        if n not in DEMOTED:
            strong = strong | live[n]
    ranked = []
    for i, n in enumerate(names):
        kept = live[n] & ~strong if n in DEMOTED else live[n]
        ranked.append(F.when(kept, F.struct(entry[n]["score"].alias("s"), F.lit(-i).alias("o"), F.lit(n).alias("n"))))
    return F.array_max(F.array(*ranked))["n"]


def resolve(detected: DataFrame, names: Sequence[str] = tuple(DETECTORS)) -> DataFrame:
    """Add ``primary`` and ``needs_review`` to the output of ``detect_all``.

    Review looks at the best score of all detectors, matched or not.
    """
    best = F.array_max(F.transform("results", lambda r: r["score"]))
    return detected.withColumn("primary", primary_setup(F.col("results"), names)).withColumn(
        "needs_review", F.col("primary").isNull() | (best < REVIEW_SCORE)
    )


def classify(moves: DataFrame, indexed: DataFrame, pivot_table: DataFrame, resolved: DataFrame) -> DataFrame:
    """One record per move: pivot, results, primary, review flag and reason.

    ``reason`` is no_csv (the symbol has no bars), no_pivot, or null.
    """
    key = list(MOVE_KEY)
    pivot = F.struct("pivot_date", "base_start", "base_end", "base_depth_pct", "breakout_rel_vol")
    found = pivot_table.select(*key, pivot.alias("pivot"))
    with_bars = indexed.select("symbol").distinct().withColumn("has_bars", F.lit(True))
    joined = (
        moves.select(*key).join(with_bars, "symbol", "left").join(found, key, "left").join(resolved, key, "left")
    )
    none = F.array().cast(f"array<{RESULT_TYPE}>")
    reason = F.when(F.col("has_bars").isNull(), "no_csv").when(F.col("pivot").isNull(), "no_pivot")
    return joined.select(
        *key, F.concat_ws("_", "symbol", "year").alias("move_key"), "pivot",
        F.coalesce(F.filter("results", lambda r: r["matched"]), none).alias("ai_classifications"),
        F.coalesce("results", none).alias("ai_all_detector_results"),
        F.col("primary").alias("ai_primary"),
        F.coalesce("needs_review", F.lit(True)).alias("needs_review"),
        reason.alias("reason"),
    )


def run_counters(classified: DataFrame) -> DataFrame:
    """Number of moves per outcome: ok, no_pivot, no_csv."""
    return classified.groupBy(F.coalesce("reason", F.lit("ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def primary_distribution(classified: DataFrame) -> DataFrame:
    """Primary setups by frequency, most common first."""
    return (
        classified.groupBy(F.coalesce("ai_primary", F.lit(UNRESOLVED)).alias("setup"))
        .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "setup")
    )

"""Writers. Each writes a new version to a new place and fails if it exists."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.operators.best_moves import MOVE_COLUMNS


def names_where(criteria: Column, met: bool) -> Column:
    picked = F.filter(criteria, lambda c: c["met"] == F.lit(met))
    return F.transform(picked, lambda c: c["name"])


def criteria_lists(result: Column) -> Column:
    """A detector result with its criteria as lists of met and failed names."""
    return F.struct(
        result["setup"].alias("setup"), result["matched"].alias("matched"), result["score"].alias("score"),
        names_where(result["criteria"], True).alias("criteria_met"),
        names_where(result["criteria"], False).alias("criteria_failed"), result["extra"].alias("extra"),
    )


def classification_records(classified: DataFrame) -> DataFrame:
    """Classified moves in the shape that ``read_classifications`` reads."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    pivot = F.when(F.col("pivot").isNotNull(), F.struct(
        day("pivot.pivot_date").alias("pivot_date"), day("pivot.base_start").alias("base_start"),
        day("pivot.base_end").alias("base_end"), F.col("pivot.base_depth_pct").alias("base_depth_pct"),
        F.col("pivot.breakout_rel_vol").alias("breakout_rel_vol"),
    ))
    users = [c for c in classified.columns if c.startswith("user_")]
    return classified.select(
        "move_key", pivot.alias("pivot"),
        *[F.transform(c, criteria_lists).alias(c) for c in ("ai_classifications", "ai_all_detector_results")],
        "ai_primary", "needs_review", "reason", *users,
    )


def write_classifications(classified: DataFrame, path: str) -> None:
    classification_records(classified).write.json(path)


def write_moves(moves: DataFrame, path: str) -> None:
    """Moves as CSV with a header, dates as ISO days."""
    days = {c: F.date_format(c, "yyyy-MM-dd") for c in ("low_date", "high_date")}
    extra = [c for c in moves.columns if c not in MOVE_COLUMNS]
    moves.withColumns(days).select(*MOVE_COLUMNS, *extra).write.option("header", True).csv(path)


def write_bars(bars: DataFrame, path: str) -> None:
    """Bars as CSV in the layout without an index, one folder per symbol.

    Rows are brought together by symbol to keep files few, but a large symbol is split
    over several tasks and files.
    """
    bars.hint("rebalance", "symbol").select(
        "symbol", F.date_format("ts", "yyyy-MM-dd").alias("DateTime"), F.col("open").alias("Open"),
        F.col("high").alias("High"), F.col("low").alias("Low"), F.col("close").alias("Close"),
        F.col("volume").cast("bigint").alias("Volume"),
    ).write.partitionBy("symbol").option("header", True).csv(path)


FOLDER_SYMBOL = r"symbol=([^/]+)/"

"""The table of moves."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.functions import parsing

# The columns of the moves file and their types.
TYPES = {
    "year": "int", "symbol": "string", "gain_pct": "double", "low_date": "date", "high_date": "date",
    "low_price": "double", "high_price": "double", "avg_vol_b": "double",
}


def read_moves(spark: SparkSession, path: str) -> DataFrame:
    """Moves from CSV with a header, in any column order; further columns stay text.

    A byte-order mark is ignored; unreadable numbers and dates are null.
    """
    df = spark.read.option("header", True).csv(path)
    df = df.toDF(*[c.replace("\ufeff", "").strip() for c in df.columns])

    def typed(name: str):
        kind, raw = TYPES.get(name), F.col(f"`{name}`")
        if kind == "double":
            return parsing.number(raw).alias(name)
        if kind == "int":
            return F.trim(raw).try_cast("int").alias(name)
        if kind == "date":
            return parsing.to_day(raw).alias(name)
        return F.trim(raw).alias(name) if name == "symbol" else raw

    return df.select(*[typed(c) for c in df.columns])


def filter_moves(moves: DataFrame, year: int | None = None,
                 symbols: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Moves of a year and/or of some symbols; pass a DataFrame for a long list."""
    if year is not None:
        moves = moves.filter(F.col("year") == year)
    if isinstance(symbols, DataFrame):
        return moves.join(symbols.select("symbol").distinct(), "symbol", "left_semi").select(*moves.columns)
    return moves.filter(F.col("symbol").isin(*symbols)) if symbols else moves


def with_key(moves: DataFrame) -> DataFrame:
    return moves.withColumn("move_key", F.concat_ws("_", "symbol", "year"))


def split_key(df: DataFrame) -> DataFrame:
    """Symbol and year from ``move_key``; the symbol itself may hold underscores."""
    return df.withColumns({
        "symbol": F.regexp_extract("move_key", r"^(.*)_(\d+)$", 1),
        "year": F.regexp_extract("move_key", r"^(.*)_(\d+)$", 2).try_cast("int"),
    })

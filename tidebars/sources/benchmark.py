"""The benchmark series, with or without volume."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.functions import parsing


def _columns(df: DataFrame) -> dict[str, str]:
    return {c.replace("\ufeff", "").strip().lower(): c for c in df.columns}


def _cell(present: dict[str, str], *names: str) -> Column:
    """First non-null of the columns that exist."""
    found = [F.col(f"`{present[n]}`") for n in names if n in present]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def _parsed(present: dict[str, str], parse, *names: str) -> Column:
    found = [parse(F.col(f"`{present[n]}`")) for n in names if n in present]
    return F.coalesce(*found) if found else F.lit(None).cast("double")


def read_benchmark(spark: SparkSession, path: str, tolerant: bool = True) -> DataFrame:
    """Benchmark bars (ts, open, high, low, close, volume), one per date in any order.

    Tolerant: close may be called Price and volume Vol. (K, M, B suffixes); rows with a missing
    price or a close at or below zero are dropped. Otherwise only rows without a date are dropped.
    The last row of a date is kept, by the path of its file and its place there.
    """
    df = spark.read.option("header", True).option("escape", '"').csv(path)
    present = _columns(df)
    closes = ("close", "price") if tolerant else ("close",)
    volumes = [F.nullif(parsing.volume(F.col(f"`{present[n]}`")), F.lit(0.0)) for n in ("volume", "vol.") if n in present]
    bars = df.select(
        F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")).alias("at"),
        parsing.to_day(_cell(present, "date", "datetime")).cast("timestamp").alias("ts"),
        *[_parsed(present, parsing.number, n).alias(n) for n in ("open", "high", "low")],
        _parsed(present, parsing.number, *closes).alias("close"),
        F.coalesce(*volumes, F.lit(0.0)).alias("volume"),
    ).filter(F.col("ts").isNotNull())
    if tolerant:
        bars = bars.dropna(subset=["open", "high", "low", "close"]).filter(F.col("close") > 0)
    last = F.max_by(F.struct("open", "high", "low", "close", "volume"), "at")
    return bars.groupBy("ts").agg(last.alias("v")).select("ts", "v.*")

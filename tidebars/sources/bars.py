"""Bars from directories of delimited files with mixed layouts.

The files are read as text, so that each file's own header decides where its
columns are. The headers, one small row per file, are staged first: Spark then knows
their true size and sends them to the lines, or shuffles both if there are too many.
"""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebars.functions import parsing
from tidebars.session import stage

FILE_SYMBOL = r"([^/]+)\.[A-Za-z]+$"


class ReadRules(NamedTuple):
    """How strict a read is.

    ``by_name`` finds columns by their header (else by position, the first line being the header whatever it says);
    ``positive_close`` drops closes at or below zero; rows lacking one of ``required`` are dropped;
    ``blank_volume`` reads an empty volume as 0; ``one_per_date`` keeps the last row of a date.
    """

    by_name: bool = True
    positive_close: bool = False
    required: tuple[str, ...] = ()
    blank_volume: bool = False
    one_per_date: bool = True


CORE = ReadRules()
TOLERANT = ReadRules(by_name=False, positive_close=True, required=("open", "high", "low", "close", "volume"), one_per_date=False)
REPAIR = ReadRules(by_name=False, required=("close", "volume"), blank_volume=True, one_per_date=False)


def raw_lines(spark: SparkSession, path: str, symbol_pattern: str = FILE_SYMBOL) -> DataFrame:
    """Lines of all files with file, symbol and their order inside the file."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    # file paths come percent-encoded; a plus sign stands for itself
    file = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return lines.select(
        F.regexp_replace("value", "^\ufeff", "").alias("line"),
        file.alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    ).filter(F.trim("line") != "").withColumn("raw_symbol", F.regexp_extract("file", symbol_pattern, 1))


def cells(line: Column) -> Column:
    return F.transform(F.split(line, ","), lambda c: F.trim(F.regexp_replace(c, '"', "")))


def is_header(line: Column) -> Column:
    """A header names the close (or price) column; data rows hold numbers there."""
    names = F.transform(cells(line), F.lower)
    return F.arrays_overlap(names, F.array(F.lit("close"), F.lit("price")))


def headers(lines: DataFrame, by_name: bool = True) -> DataFrame:
    """Header of each file: its first line, or by name the first line that names a close (else its first line).

    Every file has a row, so none is lost for want of a known header.
    """
    first = F.min(F.struct("block", "at", "line"))
    if by_name:
        named = F.min(F.when(is_header(F.col("line")), F.struct("block", "at", "line")))
        first = F.coalesce(named, first)
    return lines.groupBy("file").agg(first.getField("line").alias("header"))


def position(names: Column, *wanted: str) -> Column:
    """0-based position of the first of the wanted names that is present, else null."""
    found = [F.nullif(F.array_position(names, w), F.lit(0)) for w in wanted]
    return (F.coalesce(*found) - 1).cast("int")


def layout_by_name(names: Column) -> dict[str, Column]:
    width = F.size(names)
    when = F.coalesce(position(names, "datetime", "date"), F.when(width >= 7, F.lit(1)).otherwise(F.lit(0)))
    return {"date": when, **{c: position(names, c) for c in ("open", "high", "low", "close", "volume")}}


def layout_by_position(names: Column) -> dict[str, Column]:
    """new [index, date, o, h, l, c, v]; noindex [date, o, h, l, c, v]; old [date, c, o, h, l, v]."""
    second = F.coalesce(F.get(names, F.lit(1)).contains("date"), F.lit(False))
    first = F.coalesce(F.get(names, F.lit(0)).contains("date") & (F.get(names, F.lit(1)) != "close"), F.lit(False))
    order = {"date": (1, 0, 0), "open": (2, 1, 2), "high": (3, 2, 3), "low": (4, 3, 4), "close": (5, 4, 1),
             "volume": (6, 5, 5)}
    return {c: F.when(second, F.lit(a)).when(first, F.lit(b)).otherwise(F.lit(o)) for c, (a, b, o) in order.items()}


def read_bars(spark: SparkSession, path: str, rules: ReadRules = CORE, symbol_pattern: str = FILE_SYMBOL) -> DataFrame:
    """Bars (symbol, ts, open, high, low, close, volume) of all files under ``path``.

    The symbol is the file (or folder) name, upper-cased; where a symbol has both spellings
    the upper-case one is used. Unreadable numbers are null, never NaN. A file whose header names no close gives bars
    with null closes when read by name. Where dates may repeat, ``seq`` has the rows' order in their files.
    """
    lines = raw_lines(spark, path, symbol_pattern)
    heads = headers(lines, rules.by_name).withColumn("raw_symbol", F.regexp_extract("file", symbol_pattern, 1))
    symbol = F.upper("raw_symbol")
    spelling = F.max_by("raw_symbol", F.struct((F.col("raw_symbol") == symbol).alias("u"), F.col("raw_symbol")))
    chosen = heads.groupBy(symbol.alias("symbol")).agg(spelling.alias("raw_symbol"))
    wanted = stage(heads.join(chosen, "raw_symbol").select("file", "symbol", "header"), "headers")
    body = lines.drop("raw_symbol").join(wanted, "file").filter((F.col("line") != F.col("header")) & ~is_header(F.col("line")))
    names = F.transform(cells(F.col("header")), F.lower)
    layout = layout_by_name(names) if rules.by_name else layout_by_position(names)
    cell = {c: F.get(F.col("cell"), p) for c, p in layout.items()}
    volume = parsing.number(cell["volume"])
    if rules.blank_volume:
        volume = F.when(cell["volume"] == "", F.lit(0.0)).otherwise(volume)
    bars = body.withColumn("cell", cells(F.col("line"))).select(
        "symbol", "file", "block", "at", parsing.to_day(cell["date"]).cast("timestamp").alias("ts"),
        *[parsing.number(cell[c]).alias(c) for c in ("open", "high", "low", "close")], volume.alias("volume"),
    ).filter(F.col("ts").isNotNull())
    if rules.required:
        bars = bars.dropna(subset=list(rules.required))
    if rules.positive_close:
        bars = bars.filter(F.col("close") > 0)
    values = F.struct("open", "high", "low", "close", "volume")
    if rules.one_per_date:
        bars = bars.groupBy("symbol", "ts").agg(F.max_by(values, F.struct("file", "block", "at")).alias("v")).select(
            "symbol", "ts", "v.*")
        return bars.select("symbol", "ts", "open", "high", "low", "close", "volume")
    return bars.select("symbol", "ts", "open", "high", "low", "close", "volume", F.struct("file", "block", "at").alias("seq"))


def with_bars_flag(moves: DataFrame, bars: DataFrame) -> DataFrame:
    """Moves with ``has_bars``: whether their symbol has any bars, whatever its case."""
    known = bars.select(F.upper("symbol").alias("_known")).distinct()
    joined = moves.join(known, F.upper("symbol") == F.col("_known"), "left")
    return joined.withColumn("has_bars", F.col("_known").isNotNull()).drop("_known")


def missing_symbols(moves: DataFrame, bars: DataFrame) -> DataFrame:
    """Symbols that have moves but no bars."""
    wanted = moves.select("symbol").distinct()
    return wanted.join(bars.select("symbol").distinct(), "symbol", "left_anti")


def date_audit(spark: SparkSession, path: str, symbol_pattern: str = FILE_SYMBOL) -> DataFrame:
    """Per file: which column is the date, rows, and rows whose date is slashed."""
    lines = raw_lines(spark, path, symbol_pattern)
    names = F.transform(cells(F.col("header")), F.lower)
    second = F.coalesce(F.get(names, F.lit(1)).contains("date"), F.lit(False))
    first = F.coalesce(F.get(names, F.lit(0)).contains("date"), F.lit(False))
    date_col = F.when(second, 1).when(first, 0)
    body = lines.join(stage(headers(lines), "headers"), "file").filter((F.col("line") != F.col("header")) & ~is_header(F.col("line")))
    date = F.get(cells(F.col("line")), F.col("date_col"))
    slashed = F.coalesce((F.length(date) >= 10) & (F.substring(date, 3, 1) == "/"), F.lit(False))
    return (
        body.withColumn("date_col", date_col)
        .groupBy("file", F.col("raw_symbol").alias("symbol"), "date_col")
        .agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(slashed, 1)).alias("slashed"))
        .withColumn("needs_fix", F.col("slashed") > 0)
    )


def normalize_dates(rows: DataFrame, column: str) -> DataFrame:
    """Rewrite a date column to ISO; unrecognised values stay. Adds ``fixed`` where it changed."""
    iso = parsing.iso_text(F.col(column))
    changed = F.coalesce(iso != F.substring(F.trim(column), 1, 10), F.lit(False))
    return rows.withColumn("fixed", changed).withColumn(column, F.coalesce(iso, F.col(column)))

"""Readers where files are named or filled in odd ways."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidebars.session import stage_path
from tidebars.sources import bars as sb
from tidebars.sources import sinks
from tidebars.sources.benchmark import read_benchmark
from workload import source_queries as sq
from workload import sql as q
from workload.registry import num, query

r = q.r


@query("read_bars_lower_case_files", q.with_([q.DAILY], sq.BAR_SELECT))
def read_bars_lower_case_files(spark, sf_dir):
    """Half of the symbols have a file in lower case only; the others have both, and the one in lower case is wrong."""
    path = stage_path(spark, "lower_files")
    bars = sq.daily(spark, sf_dir)
    twice = F.substring("symbol", 1, 1).isin("1", "2", "3")
    lower = bars.withColumn("close", F.when(twice, F.col("close") * 2).otherwise(F.col("close"))).withColumn("symbol", F.lower("symbol"))
    sinks.write_bars(bars.filter(twice).unionByName(lower), path)
    return sq.shown_bars(sb.read_bars(spark, path, sb.CORE, sinks.FOLDER_SYMBOL))


@query("read_benchmark_strict", q.with_([q.DAILY], f"""
SELECT {q.day('ts')} AS ts, CASE WHEN day(ts) % 5 <> 0 THEN {r('open', 2)} END AS open, CASE WHEN day(ts) % 7 = 0 THEN -1.0 ELSE {r('close', 2)} END AS close
FROM (SELECT ts, sum(open) AS open, sum(close) AS close FROM dbars GROUP BY ts) WHERE day(ts) % 11 <> 0"""))
def read_benchmark_strict(spark, sf_dir):
    """Under strict rules only rows without a date go: missing prices and closes below zero stay, and a second row of a date counts."""
    total = sq.daily(spark, sf_dir).groupBy("ts").agg(*[F.sum(c).alias(c) for c in ("open", "high", "low", "close")])
    day = F.dayofmonth("ts")
    path = stage_path(spark, "strict_benchmark")
    good = total.select(
        F.lit(1).alias("k"), F.when(day % 11 != 0, F.date_format("ts", "MM/dd/yyyy")).alias("Date"),
        F.when(day % 5 != 0, F.format_number("open", 2)).alias("Open"), *[F.format_number(c, 2).alias(c.capitalize()) for c in ("high", "low")],
        F.when(day % 7 == 0, F.lit("-1")).otherwise(F.format_number("close", 2)).alias("Close"))
    first = good.withColumns({"k": F.lit(0), "Close": F.lit("7.00")})
    good.unionByName(first).coalesce(1).sortWithinPartitions("k").drop("k").write.option("header", True).csv(path)
    df = read_benchmark(spark, path, tolerant=False)
    return df.select(F.date_format("ts", "yyyy-MM-dd").alias("ts"), num("open", places=2), num("close", places=2))

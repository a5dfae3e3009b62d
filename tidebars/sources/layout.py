"""Bars written so that indicators read them without an exchange.

A laid-out table holds each chunk with its halo, the rows of its neighbours that windows over it read, and is bucketed by
(symbol, chunk): what the windows would be shuffled for is done once, when the table is written, and by chunk, so that a long symbol is
spread over buckets as well. Functions that take indexed bars take it as it is (``series.with_halo`` leaves it alone); ``bars`` gives the rows
themselves.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidebars.operators.indicators import FULL_HALO
from tidebars.series import CHUNK, core, with_halo


def lay_out(indexed: DataFrame, name: str, path: str, buckets: int = 64, before: int = FULL_HALO, after: int = 0, chunk_rows: int = CHUNK) -> None:
    """Write indexed bars as table ``name`` at ``path``. ``before`` and ``after`` are the longest looks back and ahead it is made for."""
    rows = with_halo(indexed, before=before, after=after, chunk_rows=chunk_rows)
    # one task a bucket, so that a bucket is one sorted file
    (rows.repartition(buckets, "symbol", "chunk").write.bucketBy(buckets, "symbol", "chunk").sortBy("symbol", "chunk", "rn")
     .option("path", path).saveAsTable(name))
    indexed.sparkSession.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('halo.before' = '{before}', 'halo.after' = '{after}', 'chunk.rows' = '{chunk_rows}')")


def laid_out(spark: SparkSession, name: str, before: int = FULL_HALO, after: int = 0, chunk_rows: int = CHUNK) -> DataFrame:
    """The table for windows that look so far; an error if it was made for less."""
    made = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    if int(made["halo.before"]) < before or int(made["halo.after"]) < after or int(made["chunk.rows"]) != chunk_rows:
        raise ValueError(f"{name} is laid out for {made['halo.before']} rows before, {made['halo.after']} after, chunks of {made['chunk.rows']}")
    return spark.table(name)


def bars(spark: SparkSession, name: str) -> DataFrame:
    """The bars of a laid-out table, each once."""
    return core(spark.table(name))

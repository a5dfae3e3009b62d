"""Tables kept in place: a change rewrites only the parts that hold its keys.

Rows are split by a hash of the key into a fixed number of folders. A change reads the folders of its keys, computes their new
rows with one of the functions of ``tables`` (which all work key by key), writes these to a folder of their own, notes that in
the table's log, and then replaces the folders. A change that dies before the note has changed nothing; one that dies after it is
finished from its folder by the next reader or writer, so no row is lost, and running a change again gives the same table. One
writer at a time.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "change bigint, folder string, done boolean"
ABOUT = "key array<string>, parts int, columns string"


class KeyedTable:
    """A table under ``path``; see ``create``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        about = spark.read.schema(ABOUT).parquet(f"{path}/about").first()
        self.key, self.parts, self.schema = list(about.key), about.parts, about.columns

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: Sequence[str], parts: int = 64) -> KeyedTable:
        """A new table of ``rows``; about a hundred MB a part is a good size."""
        spark = rows.sparkSession
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        spark.createDataFrame([(list(key), parts, columns)], ABOUT).coalesce(1).write.parquet(f"{path}/about")
        spark.createDataFrame([], LOG).write.parquet(f"{path}/log")
        table = cls(spark, path)
        table._rows_for(rows, range(parts)).write.partitionBy("part").parquet(f"{path}/rows")
        return table

    def read(self) -> DataFrame:
        self.recover()
        return self._live()

    def change(self, rows: DataFrame, new_version: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Replace the parts of the keys of ``rows`` by ``new_version(table, rows)``, which gets those parts of the table only."""
        self.recover()
        touched = [r.part for r in rows.select(self._part().alias("part")).distinct().collect()]      # as many as there are parts
        if not touched:
            return
        old = self._live(touched)
        folder = f"{self.path}/changes/{uuid.uuid4().hex}"
        self._rows_for(new_version(old, rows).select(*old.columns), touched).write.partitionBy("part").parquet(folder)
        last = self._log().agg(F.max("change")).first()[0]
        number = 0 if last is None else last + 1
        self._note(number, folder, False)
        self._replace(folder)
        self._note(number, folder, True)

    def recover(self) -> None:
        """Finish a change that was noted but not completed."""
        open_ = self._log().groupBy("change", "folder").agg(F.max("done").alias("done")).filter(~F.col("done")).orderBy("change").collect()
        for c in open_:
            self._replace(c.folder)
            self._note(c.change, c.folder, True)

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.parts)).cast("int")

    def _live(self, parts: Sequence[int] | None = None) -> DataFrame:
        found = self.spark.read.schema(f"{self.schema}, live boolean, part int").parquet(f"{self.path}/rows")
        if parts is not None:
            found = found.filter(F.col("part").isin(list(parts)))
        return found.filter("live").drop("live", "part")

    def _rows_for(self, rows: DataFrame, parts: Sequence[int]) -> DataFrame:
        """Rows with their part; every part has a mark, so that a part that loses all its rows is replaced as well."""
        marks = self.spark.createDataFrame([(p, False) for p in parts], "part int, live boolean")
        live = rows.withColumns({"part": self._part(), "live": F.lit(True)})
        return live.unionByName(marks, allowMissingColumns=True).repartition(min(self.parts, len(parts)), "part")

    def _replace(self, folder: str) -> None:
        fresh = self.spark.read.schema(f"{self.schema}, live boolean, part int").parquet(folder)
        fresh.write.partitionBy("part").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{self.path}/rows")

    def _log(self) -> DataFrame:
        return self.spark.read.schema(LOG).parquet(f"{self.path}/log")

    def _note(self, number: int, folder: str, done: bool) -> None:
        self.spark.createDataFrame([(number, folder, done)], LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

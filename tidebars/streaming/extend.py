"""Bars that arrive as a stream.

The table of bars is a folder of batches, ``batches/feed=<id>/batch=<id>/month=<first day>``, plus ``feed=start/batch=-1`` for the bars it
started with. A feed's id is the one its checkpoint was given, so feeds never write to each other's folders; a batch only
ever writes its own folder, so a batch that is run again after a failure replaces what it wrote and adds nothing twice.

A batch adds every valid bar whose time its symbol does not have yet, as ``tables.fill_bars`` does: late bars and late
symbols are kept, bars of the table never change, and an invalid bar never hides a valid one. Of bars of one time
the last sent counts within a batch (by ``seq``), the first batch among batches. One feed writes at a time. To see which bars are
there, a batch reads the months of its own bars, so that one old bar costs one old month.

``compact`` gathers what came in batches into snapshots, ``snapshots/version=<n>/month=<first day>``, rewriting only the months that
the batches touched. A manifest says which version of each month counts and which batches are in them; readers go by its last
row, and a batch that is not in it is read from its own folder, so each bar is seen once before, during and after. A compaction that
dies before its row is written has changed nothing. ``clean`` removes what no reader of the last row needs.
"""
from __future__ import annotations

import functools
import json
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidebars.operators.tables import BAR_COLUMNS, absent_bars

BAR_SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"
MANIFEST = "version bigint, months array<struct<month:date,version:bigint>>, absorbed array<struct<feed:string,batch:bigint>>"


def month_of() -> Column:
    return F.trunc(F.col("ts").cast("timestamp"), "month")


def start_table(bars: DataFrame, path: str) -> None:
    """Create the table from existing bars."""
    bars.sparkSession.createDataFrame([], MANIFEST).write.parquet(f"{path}/manifest")
    _write_months(bars, f"{path}/batches/feed=start/batch=-1", "error")
    # a folder that holds the snapshots, also while there are none
    _write_months(bars.limit(0), f"{path}/snapshots/version=-1", "error")


def _write_months(bars: DataFrame, path: str, mode: str) -> None:
    """A file or few for each month, however many tasks there were."""
    bars.select(*BAR_COLUMNS, month_of().alias("month")).hint("rebalance", "month").write.mode(mode).partitionBy("month").parquet(path)


def manifest(spark: SparkSession, path: str) -> tuple[int, dict, dict]:
    """Last version, the version of each month, and the last batch of each feed that is in them."""
    last = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").orderBy(F.desc("version")).first()
    if last is None:
        return 0, {}, {}
    return last.version, {m.month: m.version for m in last.months}, {a.feed: a.batch for a in last.absorbed}


def _batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{BAR_SCHEMA}, feed string, batch bigint, month date").parquet(f"{path}/batches")


def _any(conditions: list[Column]) -> Column:
    return functools.reduce(operator.or_, conditions, F.lit(False))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """All bars with the feed and batch they came in (``snapshot`` and its version once gathered); filter on ``month`` to read less."""
    _, months, absorbed = manifest(spark, path)
    old = _any([(F.col("feed") == feed) & (F.col("batch") <= batch) for feed, batch in absorbed.items()])
    found = _batches(spark, path).filter(~old)
    if not months:
        return found
    by_version: dict[int, list] = {}
    for month, version in months.items():
        by_version.setdefault(version, []).append(month)
    current = _any([(F.col("version") == v) & F.col("month").isin(ms) for v, ms in by_version.items()])
    held = spark.read.schema(f"{BAR_SCHEMA}, version bigint, month date").parquet(f"{path}/snapshots").filter(current)
    return held.select(*BAR_COLUMNS, F.lit("snapshot").alias("feed"), F.col("version").alias("batch"), "month").unionByName(found)


def add_batch(rows: DataFrame, batch_id: int, path: str, feed: str) -> None:
    """Write the bars of ``rows`` that the table lacks as one batch of ``feed``; ``seq`` tells which was sent last.

    Only the months of the batch are read from the table.
    """
    months = [r.month for r in rows.dropna(subset=["ts"]).select(month_of().alias("month")).distinct().collect()]      # bounded by the calendar
    before = read_table(rows.sparkSession, path).filter((F.col("feed") != feed) | (F.col("batch") < batch_id)).filter(F.col("month").isin(months))
    _write_months(absent_bars(before, rows), f"{path}/batches/feed={feed}/batch={batch_id}", "overwrite")


def read_feed(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """New bars from a folder; ``seq`` orders them by the time of their file, its path and their place in it."""
    feed = spark.readStream.schema(BAR_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    sent = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.row_index")
    return feed.select("*", sent.alias("seq"))


def feed_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a streaming query keeps in its checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first().value)["id"]


def extend_stream(feed: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep the table at ``path`` up to date from ``feed``; ``once`` stops when it is drained."""
    writer = feed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, batch_id: add_batch(df, batch_id, path, feed_id(df.sparkSession, checkpoint))
    )
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def compact(spark: SparkSession, path: str) -> int:
    """Gather all batches that are there into snapshots of the months they touch; gives the version that now counts."""
    version, months, absorbed = manifest(spark, path)
    last = {r.feed: r.batch for r in _batches(spark, path).groupBy("feed").agg(F.max("batch").alias("batch")).collect()}
    fresh = {feed: batch for feed, batch in last.items() if batch > absorbed.get(feed, -2)}
    if not fresh:
        return version
    taken = _any([(F.col("feed") == feed) & (F.col("batch") <= batch) for feed, batch in fresh.items()])
    table = read_table(spark, path).filter(taken | (F.col("feed") == "snapshot"))
    touched = [r.month for r in table.filter(F.col("feed") != "snapshot").select("month").distinct().collect()]
    version += 1
    # what an earlier try left under this number is replaced
    _write_months(table.filter(F.col("month").isin(touched)), f"{path}/snapshots/version={version}", "overwrite")
    months |= dict.fromkeys(touched, version)
    absorbed |= fresh
    row = (version, [{"month": m, "version": v} for m, v in months.items()], [{"feed": f, "batch": b} for f, b in absorbed.items()])
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return version


def clean(spark: SparkSession, path: str) -> None:
    """Remove batches that are in snapshots, and months of snapshots that a later version replaced.

    Run it when no query that was planned before the last ``compact`` is still reading.
    """
    _, months, absorbed = manifest(spark, path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def folders(at: str) -> list[str]:
        return [s.getPath().getName() for s in files.listStatus(hadoop(at)) if s.isDirectory()]

    for feed, batch in absorbed.items():
        at = f"{path}/batches/feed={feed}"
        for name in folders(at):
            if int(name.split("=")[1]) <= batch:
                files.delete(hadoop(f"{at}/{name}"), True)
    counts = {f"version={v}/month={m}" for m, v in months.items()}
    for version in folders(f"{path}/snapshots"):
        held = [f"{version}/{name}" for name in folders(f"{path}/snapshots/{version}")]
        for name in held:
            if name not in counts:
                files.delete(hadoop(f"{path}/snapshots/{name}"), True)

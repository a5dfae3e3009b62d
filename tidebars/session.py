"""Session defaults and the staging of intermediate tables.

A DataFrame that several later steps read is written once, as parquet, to the
shared folder the cluster names in ``spark.checkpoint.dir``. That cuts lineage
and survives the loss of an executor; a folder is made up only where the
setting is absent (local tests).
"""
from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A small session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidebars")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="tidebars-")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, or a temporary one where none is set (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_dir()


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a staged table; never reused, so never overwritten."""
    return f"{shared_dir(spark)}/tidebars/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back as a table."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

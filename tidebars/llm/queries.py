"""The registered queries of this package: each applies one operator to its whole table."""
from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tidebars.llm import (
    checks, fingerprint, jaccard, language, mixing, packing, pii, quality, secret_scan, sharding, spelling, suffixes, templates, vector_codes,
)
from tidebars.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}
ROWS_A_BATCH = 1000     # rows handed to Python at a time, and
BYTES_A_BATCH = 8 << 20     # bytes, or one row


def set_up(spark: SparkSession) -> None:
    """Python workers find this package, and get texts in batches of bounded size."""
    spark.sparkContext.environment["PYTHONPATH"] = str(Path(__file__).resolve().parents[2])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_A_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_A_BATCH))
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def tokenizer_paths() -> tuple[str, str]:
    """The vocabulary for tokenizers, and the same as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if check is not None:
            CHECKS[name] = check

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            set_up(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        return fn
    return add


@query("op1_pii")
def op1(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


@query("op3_packing")
def op3(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), *tokenizer_paths())


@query("op5_mixing")
def op5(spark, sf_dir):
    return mixing.report(table(spark, sf_dir, "documents"))


@query("op4_sharding")
def op4(spark, sf_dir):
    return sharding.report(table(spark, sf_dir, "documents"))


@query("op6_fingerprints")
def op6(spark, sf_dir):
    return fingerprint.report(table(spark, sf_dir, "documents"))


@query("op7_language")
def op7(spark, sf_dir):
    return language.report(table(spark, sf_dir, "documents"))


@query("op8_quality")
def op8(spark, sf_dir):
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_jaccard", checks.jaccard())
def op9(spark, sf_dir):
    return jaccard.report(table(spark, sf_dir, "documents"))


@query("op2_suffix_dedup")
def op2(spark, sf_dir):
    return suffixes.report(table(spark, sf_dir, "documents"))


@query("op10_templates")
def op10(spark, sf_dir):
    return templates.report(table(spark, sf_dir, "pages"))


@query("op11_secrets", checks.secrets())
def op11(spark, sf_dir):
    return secret_scan.report(table(spark, sf_dir, "documents"))


@query("op12_vector_codes", checks.codes())
def op12(spark, sf_dir):
    return vector_codes.report(table(spark, sf_dir, "embeddings"))


@query("op13_spelling", checks.words())
def op13(spark, sf_dir):
    return spelling.report(table(spark, sf_dir, "documents"))

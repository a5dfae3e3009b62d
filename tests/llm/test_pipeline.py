import re
from pathlib import Path

import pytest

import corpus_pipeline
from tidebars.llm.common import components

DATA = "/root/testdata/sf0.001"


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (20, 20), (3, 1)] + [(100 + i, 101 + i) for i in range(40)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {100 + i: 100 for i in range(41)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for k, (name, step) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = step(spark, docs, DATA)
        assert out.columns == docs.columns, name
        path = f"{tmp_path}/{k}"
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        if name == "language":
            kept = {r.doc_id for r in docs.collect()}
            assert kept == {r.doc_id for r in before.collect() if any(c.isalpha() for c in r.text or "")}
        if name == "pii":
            assert docs.count() == before.count()
            assert not [r for r in docs.collect() if re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text)]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_stages_take_odd_and_empty_tables(spark, odd, none):
    for docs in (odd, none):
        for name, step in corpus_pipeline.STAGES:
            out = step(spark, docs, DATA)
            out.collect()
            assert name == "packing" or out.columns == docs.columns

import re
from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from tidebars.llm import quality

from .conftest import odd_rows

LABELS = "doc_id long, quality int, toxic int"


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    count, repeated = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if count[w[i], w[i + 1], w[i + 2]] > 1:
            repeated |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    return (n, sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated),
            n < 50 or 100 * len(repeated) > 50 * n)


def base(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def test_base_counts(spark):
    texts = ["a b c a b c", "a a a a", "a a a", "x\ny\nx\n\n \nx", "#|<>\t&& é😀", "p q r s " * 20 + "t u v", " lead and trail ", "a b\x0bc\x0cd\re"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for r in quality.report(df, spark.createDataFrame([], LABELS)).collect():
        assert base(r) == plain(texts[r.doc_id]), texts[r.doc_id]
        assert r.kept == (not r.base_failed)


@pytest.mark.parametrize(("k", "n"), [(0, 10), (0, 400), (3, 500), (19, 1000), (20, 1000), (150, 10_000), (0, 1)])
def test_binomial_tail(spark, k, n):
    got = spark.createDataFrame([(k, n)], "k long, n long").select(quality.binomial_below("k", "n", 0.02).alias("p")).first().p
    exact = float(sum(comb(n, i) * (2**i) * (98 ** (n - i)) for i in range(k + 1)) * 10**30 // 100**n) / 1e30
    assert got == pytest.approx(1.0 if k >= 0.02 * n else exact, rel=1e-9)


def test_cutoffs_limit_false_rejection(spark):
    """Bad texts of symbols go where labels suffice; a stratum with few labels keeps its texts."""
    good = " ".join(f"w{i}" for i in range(80))
    rows, labels = [], []
    for i in range(1500):
        bad = i % 3 == 0
        rows.append((i, " ".join(f"w{j}###" for j in range(80)) if bad else f"{good} {i}", "en" if i < 1480 else "fr"))
        labels.append((i, 0 if bad else 1, 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in quality.report(df, spark.createDataFrame(labels, LABELS)).collect()}
    assert all(kept[i] == (i % 3 != 0) for i in range(1480))
    assert all(kept[i] for i in range(1480, 1500))


def test_labels_count_once_and_contradictions_not_at_all(spark):
    df = spark.createDataFrame([(1, 0.9)], "doc_id long, symbol_ratio double").withColumns(
        {r: F.lit(0.0) for r in quality.RULES if r != "symbol_ratio"} | {"stratum": F.lit("en")})
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 0)], LABELS)
    assert quality.cutoffs(df, labels).count() == 0


def test_odd_and_empty_tables(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, None, None)], LABELS)
    got = Counter((r.doc_id, *base(r), r.kept) for r in quality.report(odd, labels).collect())
    assert got == Counter((r[0], *plain(r[1]), not plain(r[1])[-1]) for r in odd_rows())
    assert quality.report(none, labels).count() == 0

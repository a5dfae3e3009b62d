import hashlib
import random

import numpy as np

from tidebars.llm import fingerprint

from .conftest import odd_rows


def follow(rows):
    """Rows in order, each with the text of the next."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    return [(a, b[1] or "") for a, b in zip(order, order[1:] + order[:1])]


def check(got, rows):
    want = []
    for (doc, text), after in follow(rows):
        text = text or ""
        changed = fingerprint.edited(text, after)
        one, two, three = fingerprint.fingerprints([text, changed, after])
        want.append((str(doc), len(text), hashlib.sha256(changed.encode()).hexdigest(), one.astype(">u2").tobytes().hex(),
                     two.astype(">u2").tobytes().hex(), float((one == two).mean()), float((one == three).mean())))
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == sorted(want)


def test_next_document_across_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.randint(-500, 5000), " ".join(rng.choices(["alpha", "beta", "gamma", "ä😀"], k=rng.randint(0, 60)))) for _ in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check(fingerprint.report(df).collect(), rows)


def test_one_document_follows_itself(spark):
    rows = [(1, "only one text here")]
    check(fingerprint.report(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_phrases_inside_do_not_depend_on_the_offset():
    rng = random.Random(2)
    core = "".join(rng.choices("abcdefgh ", k=4000))
    prints = fingerprint.fingerprints([core, "xyz " * 30 + core, core + " tail" * 20, "".join(rng.choices("abcdefgh ", k=4000))])
    assert (prints[0] == prints[1]).mean() > 0.85 and (prints[0] == prints[2]).mean() > 0.85
    assert (prints[0] == prints[3]).mean() < 0.1


def test_labels_are_small_and_differ():
    names = np.random.default_rng(3).integers(0, 2**63, 10_000, dtype=np.uint64)
    label = fingerprint._toss(names, np.zeros(1, np.int64))
    assert label.min() >= 0 and label.max() < 6 and (label[1:] != label[:-1]).all()


def test_batches_do_not_matter(monkeypatch):
    texts = ["aaaa" * 50, "", "b", "ab" * 90, "some words of text " * 9, "a"]
    whole = fingerprint.fingerprints(texts)
    monkeypatch.setattr(fingerprint, "CHARS", 8)
    assert (fingerprint.fingerprints(texts) == whole).all() and not whole[1].any() and whole[0].all()


def test_odd_and_empty_tables(spark, odd, none):
    check(fingerprint.report(odd).collect(), [r[:2] for r in odd_rows()])
    assert fingerprint.report(none).count() == 0

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidebars.llm import suffixes

from .conftest import odd_rows


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array_and_prefixes(s):
    order = suffixes.suffix_array(s)
    assert order == sorted(range(len(s)), key=lambda i: s[i:])
    shared = suffixes.common_prefixes(s, order)
    for k in range(1, len(s)):
        a, b = s[order[k - 1]:], s[order[k]:]
        assert shared[k] == next((h for h, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def brute(texts, length):
    """(bytes, removed, spans, hash of the rest) by counting all strings."""
    count = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = bytes(x for x, g in zip(t, gone) if not g)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts_of(seed, length):
    rng = random.Random(seed)
    letters = rng.choice(["ab", "abcdefghé"])
    pool = ["".join(rng.choices(letters, k=rng.randint(30, 300))) for _ in range(5)] + ["a" * 250]
    out = []
    for _ in range(25):
        t = list("".join(rng.choice(pool) if rng.random() < 0.6 else "".join(rng.choices(letters, k=rng.randint(1, 90))) for _ in range(rng.randint(0, 6))))
        for _ in range(rng.randint(0, 2)):
            if t:
                t[rng.randrange(len(t))] = rng.choice(letters)
        out.append("".join(t))
    return out


@pytest.mark.parametrize(("seed", "crowd"), [(1, 256), (2, 256), (3, 2)])
def test_removal_equals_brute_force(spark, monkeypatch, seed, crowd):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    texts = texts_of(seed, 100)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffixes.remove(df, 100).collect()}
    assert [got[i] for i in range(len(texts))] == brute([t.encode() for t in texts], 100)


def test_common_passage_is_dealt_by_context_not_by_start(spark, monkeypatch):
    """A passage among hundreds of different surroundings: right, in rows that grow with contexts and not with their starts."""
    rng, tables, real = random.Random(5), {}, suffixes.stage

    def stage(df, name):
        tables[name] = tables.get(name, 0) + (out := real(df, name)).count()
        return out

    monkeypatch.setattr(suffixes, "stage", stage)
    passage, ends = ("".join(rng.choices("abcdefgh ", k=n)) for n in (700, 60))
    texts = ["".join(rng.choices("ijklmnop ", k=400)) + passage + ends[:rng.choice([0, 0, 0, 7, 30, 60])] + "".join(rng.choices("ijklmnop ", k=400))
             for _ in range(320)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffixes.remove(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute([t.encode() for t in texts], 400)
    assert 0 < tables.get("dealt", 0) < 40 * len(texts)      # their strings are hundreds a text


def test_long_texts_go_in_pieces(monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 64)
    data = "".join(texts_of(9, 100)).encode()[:1500]
    _, low, high, _ = suffixes.anchors(data, 100)
    assert sorted(p for a, b in zip(low, high) for p in range(a, b + 1)) == list(range(len(data) - 99))


def test_odd_and_empty_tables(spark, odd, none):
    rows = [((r[0], r[1]), (r[1] or "").encode()) for r in odd_rows()]
    want = Counter((k[0], *b) for (k, _), b in zip(rows, brute([t for _, t in rows], 400)))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.report(odd).collect())
    assert got == want
    assert suffixes.report(none).count() == 0

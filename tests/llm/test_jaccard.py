import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidebars.llm import jaccard
from tidebars.llm.shingles import shingle_sets

from .conftest import odd_rows


def plain_set(text, k):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if len(w) >= k:
        return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def brute(rows, k, percent):
    """(doc_id, set size, component) of every row, by comparing all pairs."""
    sets = [plain_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)].append(doc)
    return Counter((doc, len(s), min(low[find(i)], default=None)) for i, ((doc, _), s) in enumerate(zip(rows, sets)))


def copies(seed, n):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([2, 4, 12, 40, 120]))]
        for _ in range(rng.choice([1, 1, 3, 12])):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                own[rng.randrange(len(own))] = f"w{rng.randint(0, 400)}"
            if rng.random() < 0.4:
                own += "a common line that many of these texts end with".split()
            out.append(" ".join(own).upper() if rng.random() < 0.1 else " ".join(own))
    return list(enumerate(out[:n]))


def test_shingles_equal_plain_sets():
    texts = [t for _, t in copies(4, 60)] + [None, "", " \n", "One two", "ONE\ttwo", "é É a\x0bb", "x" * 500]
    for k in (1, 4, 5):
        ours, plain = shingle_sets(texts, k), [plain_set(t, k) for t in texts]
        assert [len(s) for s in ours] == [len(s) for s in plain]
        for i in range(len(texts)):
            assert [len(np.intersect1d(ours[i], x)) for x in ours] == [len(plain[i] & y) for y in plain]


@pytest.mark.parametrize(("seed", "k", "percent", "block", "hot"), [(1, 4, 85, 1024, 64), (2, 5, 80, 1024, 64), (3, 4, 85, 8, 2)])
def test_components_equal_brute_force(spark, monkeypatch, seed, k, percent, block, hot):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "HOT_COUNT", hot)
    rows = copies(seed, 220)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df, k, percent).collect())
    assert got == brute(rows, k, percent)


def test_tree_loses_no_pair():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 62, rng.integers(1, 400), dtype=np.uint64)) for _ in range(60)]
    sets += [np.unique(np.concatenate((s[rng.random(len(s)) < 0.95], rng.integers(0, 1 << 62, 2, dtype=np.uint64)))) for s in sets]
    sizes, bits = np.array([len(s) for s in sets]), [jaccard.bitmap(s, jaccard.width_for(len(s))) for s in sets]
    found = set()
    for x, y, _ in jaccard.meetings(sizes, bits, np.arange(len(sets)), None, 85):
        found |= {(min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist())}
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            assert both < jaccard.need(len(sets[i]), len(sets[j]), 85) or (j, i) in found


def test_first_common_shingle_keeps_linking_pairs():
    sets = [s for s in shingle_sets([t for _, t in copies(11, 120)], 4) if len(s)]
    tokens = defaultdict(list)
    for i, s in enumerate(sets):
        for place, t in enumerate(jaccard._prefix(s, jaccard._NONE, 85).tolist()):
            tokens[t].append((i, place))
    met, rows = defaultdict(set), 0
    for t, found in tokens.items():
        at, place = (np.array(x) for x in zip(*found))
        sizes = np.array([len(sets[i]) for i in at])
        keep = jaccard.reaching(sizes, sizes - place, at, 85)
        met[t], rows = set(at[keep].tolist()), rows + int(keep.sum())
    for i in range(len(sets)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                assert any(i in m and j in m for m in met.values())
    assert rows < 0.8 * sum(len(found) for found in tokens.values() if len(found) > 1)


def test_hopeless_meetings_move_no_bitmaps(spark, monkeypatch):
    staged, write = {}, jaccard.stage
    monkeypatch.setattr(jaccard, "stage", lambda df, name: staged.setdefault(name, write(df, name)))
    line = " ".join(f"c{i}" for i in range(12))
    rows = [(n, line + "".join(f" t{n}x{i}" for i in range(2 * 2**n))) for n in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.component_id for r in jaccard.join(docs).collect()}
    assert out == {n: n for n, _ in rows}
    assert staged["mixed"].count() and not staged["open"].count()


def test_tree_descends_in_bounded_steps(monkeypatch):
    sizes = np.full(300, 40_000)
    bits = np.random.default_rng(5).integers(0, 2**63, (300, jaccard.BITS), dtype=np.uint64)
    tree, seen = jaccard.Tree(sizes, bits), []
    monkeypatch.setattr(jaccard, "likely", lambda one, two, left, right, percent: seen.append(len(left)) or np.ones(len(left), bool))
    pairs = sum(len(x) for x, _, _ in tree.meet(tree, 20))
    assert pairs == 300 * 299 // 2 and max(seen) * jaccard.BITS <= jaccard.STEP


def test_keep_one(spark):
    rows = [(4, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (9, ""), (7, None), (5, "other words altogether in this one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard.keep_one(df).collect()) == [2, 5, 7, 9]


def test_odd_and_empty_tables(spark, odd, none):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.report(odd).collect())
    assert got == brute([r[:2] for r in odd_rows()], 4, 85)
    assert jaccard.keep_one(odd).columns == odd.columns
    assert jaccard.report(none).count() == 0

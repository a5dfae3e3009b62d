import re
from collections import Counter, defaultdict

import pytest

from tidebars.llm import mixing

from .conftest import odd_rows


def test_fit_meets_the_budget():
    for lengths, counts, budget in [([1, 2, 5], [3, 3, 3], 17), ([7], [10], 40), ([3, 50, 900], [100, 20, 5], 2345), ([2, 4], [5, 5], 7), ([5], [1], 3)]:
        take = mixing.fit_lengths(lengths, counts, budget)
        got = sum(n * t for n, t in zip(lengths, take))
        assert all(0 <= t <= c for t, c in zip(take, counts)) and got <= budget
        reach = {0}
        for n, c in zip(lengths, counts):
            reach = {r + n * k for r in reach for k in range(c + 1) if r + n * k <= budget}
        assert got == max(reach)


def plain_targets(sizes, share=1.5, most=2.0):
    """Targets by rounds of sharing, as the contract words it."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total, over = sum(weight[s] for s in open_), set()
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in open_:
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                over.add(s)
        open_ -= over
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, texts):
    sizes = defaultdict(int)
    for _, t, s in texts:
        sizes[s] += words(t)
    want = plain_targets(sizes)
    assert Counter((r.doc_id, r.size, r.source) for r in rows) == Counter((d, words(t), s) for d, t, s in texts)
    taken = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-6)
        assert 0 <= r.taken <= 2
        taken[r.source] += r.size * r.taken
    return {s: (taken[s], want[s]) for s in want}


def test_words_come_near_targets(spark):
    texts = [(i, "w " * (1 + i % 17), ["a", "b", "Z", "é", None][i % 5]) for i in range(400)] + [(900 + i, "w w w", "a") for i in range(200)]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string").repartition(4)
    rows = mixing.mix(df).collect()
    for got, want in check(rows, texts).values():
        assert abs(got - want) <= 1
    assert sorted(rows) == sorted(mixing.mix(df.repartition(2)).collect())


def test_reported_words_come_near_targets(spark):
    """The report gives words, so its sums per source are the target without any factor."""
    texts = [(i, "w " * (1 + i % 17), ["a", "b", "Z", "é", None][i % 5]) for i in range(400)]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    taken, target = Counter(), {}
    for r in mixing.report(df).collect():
        source = texts[r.doc_id][2]
        taken[source] += r.taken
        target[source] = r.target
        assert r.taken % r.size == 0
    assert len(target) == 5 and all(abs(taken[s] - t) <= 1 for s, t in target.items())


def test_repeat_follows_the_mix(spark):
    texts = [(i, "w " * (1 + i % 7), ["a", "b"][i % 2]) for i in range(100)] + [(5, "w " * 6, "b")] * 3
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    taken = Counter()
    for r in mixing.mix(df).collect():
        taken[r.doc_id] += r.taken
    assert Counter(r.doc_id for r in mixing.repeat(df).collect()) == +taken


def test_odd_and_empty_tables(spark, odd, none):
    check(mixing.mix(odd).collect(), [(r[0], r[1], r[3]) for r in odd_rows()])
    assert mixing.repeat(odd).columns == odd.columns
    assert mixing.report(none).count() == 0 and mixing.repeat(none).count() == 0

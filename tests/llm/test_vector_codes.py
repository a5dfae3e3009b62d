"""Vector codes against plain Lloyd rounds in Python integers."""
import hashlib
import math
import random

import numpy as np
import pytest

from tidebars.llm import vector_codes as v

SCHEMA = "vec_id long, embedding array<float>, label int, x string, code string, dist int"


def plain(rows, entries=16, rounds=6):
    def good(e):
        return e is not None and all(x is not None and math.isfinite(x) for x in e)

    def last(r):
        return (r[0] is None, r[0] or 0)

    rows = [r for r in rows if good(r[1])]
    if not rows:
        return []
    first = min(rows, key=last)
    n = min(len(r[1]) for r in rows if last(r) == last(first))
    rows = [(r[0], [math.floor(4096 * float(np.float32(x))) for x in r[1]], r[2]) for r in rows if len(r[1]) == n]
    rows.sort(key=lambda r: (*last(r), r[1]))
    cuts = [i * n // 8 for i in range(9)]
    spans = list(zip(cuts, cuts[1:]))
    books = [[r[1][a:b] for r in rows[:entries]] for a, b in spans]

    def far(x, e):
        return sum((p - q) ** 2 for p, q in zip(x, e))

    def code(x):
        return [min(range(len(book)), key=lambda i: (far(x[a:b], book[i]), i)) for book, (a, b) in zip(books, spans)]

    for _ in range(rounds):
        codes = [code(r[1]) for r in rows]
        for p, (a, b) in enumerate(spans):
            for i in range(len(books[p])):
                own = [r[1][a:b] for r, c in zip(rows, codes) if c[p] == i]
                if own:
                    books[p][i] = [sum(col) // len(own) for col in zip(*own)]
    codes = [code(r[1]) for r in rows]
    errors = [sum(far(r[1][a:b], books[p][c[p]]) for p, (a, b) in enumerate(spans)) for r, c in zip(rows, codes)]
    sums = {}
    for r, e in zip(rows, errors):
        sums[r[2]] = sums.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return [(r[0], "".join(f"{c:02x}" for c in cs), e, sums[r[2]], sha) for r, cs, e in zip(rows, codes, errors)]


def check(spark, rows):
    got = [tuple(r) for r in v.report(spark.createDataFrame([(*r, "x", "c", 1) for r in rows], SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)


def rows_of(n, d, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, spread, (30, d))
    return [(int(i * 3), (centers[rng.integers(30)] + rng.normal(0, 0.1, d)).astype(np.float32).tolist(), int(rng.integers(4)) if i % 5 else None)
            for i in range(n)]


@pytest.mark.parametrize("n,d", [(2500, 16), (700, 64), (9, 16), (300, 13), (40, 3)])
def test_against_plain_rounds(spark, n, d):
    check(spark, rows_of(n, d, n))


def test_ties_and_repeats(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 40), [rng.choice([-0.5, 0.0, 0.5, -0.0001]) for _ in range(8)], rng.choice([1, 2, None])) for _ in range(400)]
    check(spark, rows + rows[:50])


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = rows_of(60, 16, 9)
    rows += [(1, None, 1), (2, [None] + [0.0] * 15, 1), (4, [inf] + [0.0] * 15, 1), (5, [nan] * 16, 2), (7, [1.0] * 15, 3), (8, [], 1), (None, [0.25] * 16, None),
             (None, None, None), rows[3], rows[3]]
    check(spark, rows)
    check(spark, [])
    check(spark, [(1, None, 1), (2, [nan], 2)])
    check(spark, [(1, [], 1), (2, [], None)])


def test_large_components_do_not_crash(spark):
    rows = [(i, [(-1.0) ** i * 3e38 / (i + 1)] * 16, 1) for i in range(40)]
    assert v.report(spark.createDataFrame([(*r, "x", "c", 1) for r in rows], SCHEMA)).count() == 40
    # beyond exact doubles, still exact
    check(spark, [(i, [float((i * 7919 + j * 104729) % 60000 - 30000) for j in range(64)], i % 2) for i in range(120)])


def test_active_entries_equal_full_scans():
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (500, 2))
    for seed in range(20):
        rng = np.random.default_rng(seed)
        old = rng.integers(-3, 4, (6, 2))
        new, moved = old.copy(), rng.random(6) < 0.4
        new[moved] = rng.integers(-3, 4, (int(moved.sum()), 2))
        moved = (new != old).any(1)
        code, dist = v.nearest(x, old)
        v.reassign(x, new, moved, code, dist)
        want, far = v.nearest(x, new)
        assert (code == want).all() and (dist == far).all()

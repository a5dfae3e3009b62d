"""Spelling variants against all pairs of a small vocabulary."""
import random
import re
import zlib
from collections import Counter

from tidebars.llm import spelling

from .conftest import odd_rows


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            if h % 199 == 0:
                low = low[:h % len(low)] + low[h % len(low) + 1:]
            counts[low] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 5 * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w
    return sorted((w, form.get(w) or "", root(w), n[w], len(near[w]), n[form[w]] if w in form else -1) for w in n)


def check(got, rows):
    assert sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in got) == plain(rows)


def variants(rng, word, n):
    out = {word}
    while len(out) < n:
        w, i, c = rng.choice(sorted(out)), rng.randint(0, 20), rng.choice("abeéßÿ×z")
        i %= len(w)
        out.add(rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1:], w[:i] + c + w[i + 1:]]))
    return sorted(out)


def test_against_all_pairs(spark):
    rng = random.Random(4)
    words = [w for stem in ("amplitude", "banana", "aaaaaaaa", "Größenordnung", "spelling", "letters", "variant", "abababab", "zzzzzzzzzzzzzzzz")
             for w in variants(rng, stem, 25)]
    weight = [5 ** rng.randint(0, 6) for _ in words]
    rows = [(i, " ".join(w if rng.random() < 0.5 else w.upper() for w in rng.choices(words, weight, k=300))) for i in range(120)]
    rows += [(1000 + i, " ".join(["chainaaa"] * (i < 6) + ["chainaab"] * (i < 40) + ["chainabb"])) for i in range(300)]
    assert sum(1 for r in plain(rows) if r[1]) > 20 and any(r[1] and r[2] != r[1] for r in plain(rows))
    check(spelling.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect(), rows)


def test_odd_rows(spark, odd, none):
    check(spelling.report(odd).collect(), [(r[0], r[1]) for r in odd_rows()])
    assert spelling.report(none).collect() == []
    rows = [(1, "lengthy" * 30000 + " word " + "lengthy" * 30000)] * 5 + [(2, "x" * 50000)] * 3 + [(3, "x" * 50000)] * 3
    check(spelling.report(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_hot_word_has_many_near_words(spark):
    hub = "abcdefgh"
    near = [hub[:i] + c + hub[i + 1:] for i in range(8) for c in "klmnopqr"]
    rows = [(i, " ".join(near)) for i in range(6)] + [(i, hub + " " + hub) for i in range(40)]
    got = {r.word: r for r in spelling.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    check(got.values(), rows)
    assert got[hub].n_near >= 60

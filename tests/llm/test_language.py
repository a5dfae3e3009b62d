import random
import zlib

import numpy as np

from tidebars.llm import language

from .conftest import odd_rows

WORDS = {"en": "the and of with this that from into which there".split(), "de": "der die und nicht für über schön ich wir größe".split(),
         "es": "el los que año señor más también niño donde aquí".split()}


def texts(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS[lang], k=rng.randint(5, 40))), lang) for i in range(n) for lang in [rng.choice(list(WORDS))]]


def test_gradients_equal_differences():
    net = language.Network(3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    ids, lengths = language._pad([b"ab", b"hello", "größe".encode(), b"x"])
    labels = np.array([0, 1, 2, 1])
    _, grads = net.gradients(ids, lengths, labels)
    rng = np.random.default_rng(0)
    for name, w in net.w.items():
        at = tuple(rng.integers(0, s) for s in w.shape) if name != "e" else (ids[1, 0], 2)
        old, losses = w[at], []
        for step in (1e-5, -1e-5):
            w[at] = old + step
            losses.append(net.gradients(ids, lengths, labels)[0])
        w[at] = old
        assert abs((losses[0] - losses[1]) / 2e-5 - grads[name][at]) < 1e-4, name


def test_held_out_accuracy(spark):
    rows = texts(600)
    found = language.report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    truth = {d: lang for d, _, lang in rows}
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 3 == 1}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_sample_counts_texts_not_copies(spark):
    """Copies neither thin out the sample nor empty it, and words beyond long blanks are learned from."""
    rows = [(f"{WORDS['en'][i % 9]} number {i}", "en") for i in range(300) for _ in range(40)]
    rows += [(f"{WORDS['de'][i]} zahl", "de") for i in range(5) for _ in range(2000)]
    rows += [(" " * 5000 + f"palabra {i}", "es") for i in range(3)]
    drawn = language.sample(spark.createDataFrame(rows, "text string, lang string").repartition(4)).collect()
    assert {lang: sum(r.lang == lang for r in drawn) for lang in WORDS} == {"en": 300, "de": 5, "es": 3}
    langs, network = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert langs == ["de", "en", "es"] and network is not None
    assert {bytes(r.words[0]) for r in drawn if r.lang == "es"} == {b"palabra"}


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows = texts(200)
    changed = [(d, t, "zz" if zlib.crc32(str(d).encode()) % 3 == 1 else lang) for d, t, lang in rows]
    a, b = (sorted(language.report(spark.createDataFrame(x, "doc_id long, text string, lang string")).collect()) for x in (rows, changed))
    assert a == b


def test_known_keeps_unlabelled_texts_and_fills_labels(spark):
    """Without any label the texts with a letter stay; otherwise missing labels, and only those, come from the network."""
    schema = "doc_id long, text string, lang string, score double"
    bare = [(1, "some text", None, 0.5), (2, "12 + 3", None, 0.5), (3, None, None, 0.5), (4, "ß", None, 0.5), (5, "", None, 0.5)]
    assert sorted(map(tuple, language.known(spark.createDataFrame(bare, schema)).collect())) == [bare[0], bare[3]]
    full = [(d, t, lang, 0.5) for d, t, lang in texts(300)]
    rows = [(d, t, None if d % 5 == 0 else "es" if d == 1 else lang, s) for d, t, lang, s in full]
    got = {r.doc_id: r for r in language.known(spark.createDataFrame(rows + [(900, "1 2", None, 0.5)], schema)).collect()}
    assert set(got) == set(range(300)) and all(r.score == 0.5 for r in got.values())
    assert all(got[d].lang == lang for d, _, lang, _ in rows if lang)
    assert sum(got[d].lang == full[d][2] for d in range(0, 300, 5)) >= 57


def test_network_runs_once_a_text(spark):
    """A filter on the label must not be pushed below the network, which would run it, and its workers, twice."""
    df = spark.createDataFrame([*texts(60), (60, None, None), (61, "the and of", None)], "doc_id long, text string, lang string")
    plan = language.known(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [predict") == 1


def test_pooled_words_do_not_depend_on_the_batch():
    net = language.Network(4)
    words = language.segments("some words of different length, größer " + "z" * 100)
    whole = net.pool_words(words)
    assert np.allclose(whole, np.concatenate([net.pool_words([w]) for w in words]), atol=1e-4)
    assert b"".join(words) == "some words of different length, größer".replace(" ", "").encode() + b"z" * 100


def test_odd_and_empty_tables(spark, odd, none):
    found = language.report(odd).collect()
    assert len(found) == len(odd_rows())
    letters = {r[0]: any(c.isalpha() for c in r[1] or "") for r in odd_rows() if r[0] not in (None, 3)}
    for r in found:
        if r.doc_id in letters:
            assert (r.lang_pred != "und") == letters[r.doc_id] and (letters[r.doc_id] or r.score == 0)
    assert language.known(odd).columns == odd.columns
    assert language.report(none).count() == 0
    bare = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in language.report(bare).collect()] == [("und", 0.0)]

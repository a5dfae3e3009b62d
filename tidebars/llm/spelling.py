"""Spelling variants of the words of a corpus, by partition-and-enumerate signatures.

A word's letters are a multiset, written as a binary vector with a place for the first, second, third, ... occurrence of each
letter. One inserted or deleted letter changes one place, one replaced letter two, so words within one edit differ in at most
``DISTANCE`` (2) places. Places are dealt to ``PARTS`` parts; two such words agree in all but two parts at least, so they agree on
one of the subsets of ``PARTS - 2`` parts. Each subset gives a signature: the word's places inside it. Words that share a signature
and whose lengths differ by one at most meet in an equi-join, and the edit distance decides in it; the signatures are exact, so no
near pair is missed. Parts are balanced by how often their places are used in the vocabulary.

Signatures are held as hashes of the chosen places; a collision costs a comparison and changes nothing.

Null text has no words. Repeated rows count as often as they come. A null id counts as empty text. Equal counts are told apart by the
word in code-point order. An empty table, or one without words of ``LEAST`` letters, gives no rows. Other columns are ignored. Words
of any length are handled; from the ``DEEP``-th occurrence on a letter's places share a part.
"""
from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.session import stage

RUN = r"[A-Za-zÀ-ÿ]+"
LEAST = 6          # code points of a word
OFTEN = 5          # occurrences of a word; also how much more frequent a form must be
SLIP = 199         # one run in so many loses a code point
DISTANCE = 2
PARTS = 8
DEEP = 4
HELD = 200_000     # words that a task counts before it hands them on
_LOWER = {c: c + 32 for c in range(65, 91)}


def read_as(doc_id: str, run: str) -> str:
    """A run as it counts: A-Z in lower case, and without one code point where the hash of id and run says so."""
    low = run.lower() if run.isascii() else run.translate(_LOWER)
    h = zlib.crc32(f"{doc_id}:{low}".encode())
    if h % SLIP:
        return low
    at = h % len(low)
    return low[:at] + low[at + 1:]


def _counted(held: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame, least: int = LEAST, often: int = OFTEN) -> DataFrame:
    """Rows (word, n) over whole texts; a task counts its words before they are shuffled."""
    pattern = re.compile(RUN.replace("+", f"{{{least},}}"))      # shorter runs only get shorter

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for run, n in Counter(pattern.findall(text)).items():
                    word = read_as(doc_id, run)
                    if len(word) >= least:
                        held[word] += n
            if len(held) > HELD:
                yield _counted(held)
                held.clear()
        yield _counted(held)

    texts = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def places(word: str) -> list[tuple[str, int]]:
    """The multiset of letters as (letter, occurrence), occurrences from ``DEEP`` on together."""
    seen: Counter[str] = Counter()
    out = []
    for c in word:
        seen[c] += 1
        out.append((c, min(seen[c], DEEP)))
    return out


def deal(words: DataFrame, parts: int = PARTS) -> dict[tuple[str, int], int]:
    """Part of each place: the most used first, to the part least used so far. There are a few hundred places."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used: Counter[tuple[str, int]] = Counter()
        for batch in batches:
            for word in batch.column("word").to_pylist():
                used.update(places(word))
        yield pa.RecordBatch.from_arrays([
            pa.array([c for c, _ in used], pa.string()), pa.array([k for _, k in used], pa.int32()), pa.array(used.values(), pa.int64())],
            names=["c", "k", "n"])

    used = words.select("word").mapInArrow(count, "c string, k int, n long").groupBy("c", "k").agg(F.sum("n").alias("n")).collect()
    load, out = [0] * parts, {}
    for r in sorted(used, key=lambda r: (-r.n, r.c, r.k)):
        part = load.index(min(load))
        load[part] += r.n
        out[r.c, r.k] = part
    return out


def _mark(name: str, number: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{name}{number}".encode(), digest_size=8).digest())


def signatures(words: DataFrame, dealt: dict[tuple[str, int], int], parts: int = PARTS, distance: int = DISTANCE) -> DataFrame:
    """Rows (sig, length, word, n): one for each subset of all but ``distance`` parts."""
    chosen = np.zeros((parts, 0), np.uint64)
    for subset in itertools.combinations(range(parts), parts - distance):
        chosen = np.hstack([chosen, np.isin(np.arange(parts), subset).astype(np.uint64)[:, None]])
    salt = np.array([_mark("subset", i) for i in range(chosen.shape[1])], np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks: dict[tuple[str, int], int] = {}
        for batch in batches:
            words_here = batch.column("word").to_pylist()
            sums = [[0] * parts for _ in words_here]
            for own, word in zip(sums, words_here, strict=True):
                seen: Counter[str] = Counter()
                for c in word:
                    seen[c] += 1
                    mark = marks.get((c, seen[c])) or _mark(c, seen[c])
                    if seen[c] <= DEEP:       # a few hundred are remembered
                        marks[c, seen[c]] = mark
                    own[dealt[c, min(seen[c], DEEP)]] += mark
            held = np.array([[s & 0xFFFFFFFFFFFFFFFF for s in own] for own in sums], np.uint64).reshape(-1, parts)
            sig = (held @ chosen + salt).view(np.int64)       # sums modulo 2**64
            at = pa.array(np.repeat(np.arange(len(words_here)), sig.shape[1]))
            lengths = pa.array([len(w) for w in words_here], pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array(sig.ravel()), lengths.take(at), batch.column("word").take(at), batch.column("n").take(at)], names=["sig", "length", "word", "n"])

    return words.select("word", "n").mapInArrow(sign, "sig long, length int, word string, n long")


def near_pairs(words: DataFrame) -> DataFrame:
    """Rows (a, b, n_a, n_b), each pair of words one edit apart once. ``words`` (word, n) is read several times: a staged table."""
    signed = stage(signatures(words, deal(words)), "word_signatures")
    left = signed.select("sig", "length", F.col("word").alias("a"), F.col("n").alias("n_a"))
    right = signed.select("sig", F.explode(F.array("length", F.col("length") + 1)).alias("length"), F.col("length").alias("own"),
                          F.col("word").alias("b"), F.col("n").alias("n_b"))
    once = (F.col("own") < F.col("length")) | (F.col("a") < F.col("b"))
    near = F.levenshtein("a", "b", 1) == 1
    return left.join(right, ["sig", "length"]).where(once & near).select("a", "b", "n_a", "n_b").distinct()


def forms(words: DataFrame, often: int = OFTEN) -> DataFrame:
    """``words`` with n_near, and form and form_n where the most frequent near word is ``often`` times as frequent."""
    pairs = stage(near_pairs(words), "word_pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    is_form = -F.col("best.m") >= often * F.col("n")
    return words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.m")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """Adds ``root``: the end of the chain of forms. A form is more frequent than its word, so chains end; each round doubles their steps."""
    held = stage(found.where("form is not null").select("word", F.col("form").alias("root")), "word_roots")
    while True:
        on = held.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        step = stage(held.join(on, F.col("root") == F.col("_at"), "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("went")), "word_roots")
        held = step.select("word", "root")
        if step.where("went").isEmpty():
            break
    return found.join(held, "word", "left").withColumn("root", F.coalesce("root", "word"))


def report(docs: DataFrame) -> DataFrame:
    words = stage(vocabulary(docs.select("doc_id", "text")), "vocabulary")
    found = stage(forms(words), "word_forms")
    return roots(found).select("word", "form", "root", "n", "n_near", "form_n")

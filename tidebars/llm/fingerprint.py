"""Document fingerprints by locally consistent parsing.

A text's code points are parsed into phrases, the phrases into longer phrases, and so on. At every level runs of equal
names become one name, deterministic coin tossing turns names into labels below six that differ between neighbours,
local maxima of the labels start phrases, and a phrase's name is a hash of the names in it. A boundary depends on a few
names around it only, so equal substrings get equal phrases inside, wherever they lie. The fingerprint has the smallest
hashes of the names of levels 2, 3 and 4 under ``SLOTS`` seeds each, 16 bits a slot; likeness is the share of equal slots.

Null text counts as empty; an empty text's fingerprint has no phrase (likeness 1 to another empty text, 0 to any other).
Order for "the next document": doc_id, null first; then text, null first, so repeated ids are in a defined order.
Extra columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.shingles import mixed, powers

SLOTS = {2: 16, 3: 32, 4: 16}     # slots by level
ROWS = 20_000                     # documents of a range of ids at most, about
CHARS = 1 << 19                   # code points parsed at a time (a longer text alone)
_SEEDS = np.random.default_rng(77).integers(1, 2**63, sum(SLOTS.values()), dtype=np.uint64)


def _toss(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below six, different for neighbours that differ; ``first`` marks the first name of each text."""
    label = names
    for _ in range(4):
        left = np.empty_like(label)
        left[1:] = label[:-1]
        left[first] = label[first] ^ np.uint64(1)
        diff = label ^ left
        low = diff & (~diff + np.uint64(1))
        place = np.bitwise_count(low - np.uint64(1)).astype(np.uint64)
        label = (place << np.uint64(1)) | ((label >> place) & np.uint64(1))
    return label.astype(np.int8)


def _collapse(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal names become one name that knows the length of the run."""
    new = np.empty(len(names), bool)
    new[0] = True
    np.not_equal(names[1:], names[:-1], out=new[1:])
    new[first] = True
    at = np.flatnonzero(new)
    if len(at) == len(names):
        return names, first
    size = np.diff(np.append(at, len(names))).astype(np.uint64)
    return np.where(size > 1, mixed(names[at] + size * np.uint64(0xA24BAED4963EE407)), names[at]), np.searchsorted(at, first)


def parse(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of one level, and the places of each text's first phrase."""
    names, first = _collapse(names, first)
    label = _toss(names, first)
    start = np.zeros(len(names), bool)
    start[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    start[first[1:] - 1] = False      # the last name of a text has no right neighbour
    start[first] = True
    at = np.flatnonzero(start)
    size = np.diff(np.append(at, len(names)))
    place = np.arange(len(names)) - np.repeat(at, size)
    sums = np.add.reduceat(mixed(names) * powers(int(size.max()) + 1)[place + 1], at)
    return mixed(sums + size.astype(np.uint64)), np.searchsorted(at, first)


def fingerprints(texts: list[str]) -> np.ndarray:
    """One row of slots for each text; zeros for an empty one."""
    out = np.zeros((len(texts), len(_SEEDS)), np.uint16)
    sizes = np.array([len(t) for t in texts], np.int64)
    full = np.flatnonzero(sizes)
    part, room = [], CHARS
    for i in [*full.tolist(), -1]:
        if part and (i < 0 or sizes[i] > room):
            _fill(out, texts, part, sizes)
            part, room = [], CHARS
        part.append(i)
        room -= sizes[i]
    return out


def _fill(out: np.ndarray, texts: list[str], part: list[int], sizes: np.ndarray) -> None:
    codes = np.frombuffer("".join(texts[i] for i in part).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    first = np.cumsum(sizes[part]) - sizes[part]
    with np.errstate(over="ignore"):
        names, slot = mixed(codes + np.uint64(1)), 0
        for level in range(1, max(SLOTS) + 1):
            names, first = parse(names, first)
            for _ in range(SLOTS.get(level, 0)):
                low = np.minimum.reduceat(mixed(names ^ _SEEDS[slot]), first)
                out[part, slot] = (low & np.uint64(0xFFFF)) | np.uint64(1)
                slot += 1


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(1)


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter (rounded down) replaced by the first as many code points of ``following``."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def _describe(ids: list, texts: list[str], nexts: list[str]) -> pd.DataFrame:
    changed = [edited(t, f) for t, f in zip(texts, nexts, strict=True)]
    own, after, far = fingerprints(texts), fingerprints(changed), fingerprints(nexts[-1:])
    # a text's follower is the next text of the list, but for the last
    follow = np.concatenate((own[1:], far))
    return pd.DataFrame({
        "doc_id": pd.array(ids, "Int64"), "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
        "fingerprint": [x.astype(">u2").tobytes().hex() for x in own],
        "edited_fingerprint": [x.astype(">u2").tobytes().hex() for x in after],
        "near_edited": likeness(own, after), "near_next": likeness(own, follow)})


KINDS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
         "near_edited double, near_next double")


def report(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its text edited with the next document's."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.withColumn("place", F.coalesce("doc_id", F.lit(-(1 << 63))))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // ROWS)
    shares = ", ".join(str(i / parts) for i in range(1, parts))
    cuts = docs.agg(F.expr(f"percentile_approx(place, array({shares}), 10000)")).first()[0] or []
    cuts = sorted(set(cuts))
    ranged = docs.withColumn("range", F.expr(f"size(filter(array({', '.join(f'{c}L' for c in cuts)}), c -> c < place))") if cuts else F.lit(0))
    # the document that follows a range is the first of the next range that has one: one row a range
    firsts = sorted((r.place, r.range) for r in ranged.groupBy("range").agg(F.min("place").alias("place")).collect())
    tails = [(place, firsts[i - 1][1]) for i, (place, _) in enumerate(firsts)]     # the first of all follows the last
    tails = spark.createDataFrame(tails, "place long, before int")
    tails = ranged.join(F.broadcast(tails), "place").select("doc_id", "text", "place", F.col("before").alias("range"), F.lit(1).alias("tail"))
    both = ranged.select("doc_id", "text", "place", "range", F.lit(0).alias("tail")).unionByName(tails)
    both = both.repartition(parts, "range").sortWithinPartitions("range", "tail", "place", "text")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, texts, range_, over = [], [], None, False

        def take(done: bool) -> Iterator[pd.DataFrame]:
            """Describe the rows whose follower is known; the last text stays for its follower."""
            if len(texts) > 1:
                yield _describe(ids[:-1], texts[:-1], texts[1:])
            del ids[:-1], texts[:-1]
            if done:
                ids.clear()
                texts.clear()

        for batch in batches:
            for doc, text, own, tail in zip(batch.doc_id, batch.text, batch["range"], batch["tail"], strict=True):
                if own != range_:
                    ids.clear()
                    texts.clear()
                    range_, over = own, False
                if over:
                    continue      # only the first row of the next range follows
                ids.append(None if pd.isna(doc) else int(doc))
                texts.append(text or "")
                if tail:
                    over = True
                    yield from take(True)
            if not over:
                yield from take(False)

    return both.select("doc_id", "text", "range", "tail").mapInPandas(walk, KINDS)

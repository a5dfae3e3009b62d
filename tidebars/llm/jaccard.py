"""Exact n-gram Jaccard join with signature trees.

Texts become sets of word shingles; two link when ``100 * |A & B| >= percent * |A | B|``. Equal sets are one class, so
copies of a text are never expanded into pairs. Classes meet where their prefixes share a shingle: of any two sets that
link, the first ``n - ceil(n * percent / 100) + 1`` shingles in one global order have a shingle in common. The order
puts the ``HOT`` most frequent shingles last, so that common lines do not gather documents; any order is exact.

Where classes meet, a signature tree does the search: leaves hold a class's bitmap of shingles, nodes the OR of the
bitmaps below and their range of sizes; two nodes are descended together only while the largest possible overlap
reaches what their smallest sizes need. The groups of each class's smallest and largest shared shingle give spanning
pairs, which are checked by their whole sets and link most classes; after them only meetings of different components
remain. A class takes part in one only if some class of another component could reach the threshold there: where a shingle is the first
that two sets share, no more than what follows it is common. Sizes and places decide that before any bitmap moves; all pairs of
those that stay go through the trees and the same check. Groups beyond ``BLOCK`` classes are split into blocks, and
blocks meet block by block in tasks of bounded size.

Text without words, empty or null has an empty set and links with nothing. Rows are told apart by their shingle sets,
not by doc_id, so repeated, null or clashing ids are allowed; other columns are ignored. A component is named by the
smallest doc_id in it.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebars.llm.common import WORD, components, in_sieve, map_groups, sieve
from tidebars.llm.shingles import shingle_sets
from tidebars.session import stage

HOT = 20_000       # frequent shingles put last; the bound keeps the list small at any size of the corpus
HOT_COUNT = 64     # and only if so many prefixes hold them
BLOCK = 4096       # classes of one group that meet in one task
FAN = 16           # children of a tree node
BITS = 1024        # longest bitmap is this times 64
STEP = 1 << 19     # words of bitmaps compared at a time, on each side


def need(a, b, percent: int):
    """Smallest overlap with which sets of these sizes link."""
    return -(-percent * (a + b) // (100 + percent))


def bitmap(shingles: np.ndarray, width: int) -> np.ndarray:
    bits = np.zeros(width, np.uint8)
    bits[(shingles & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def width_for(n: int) -> int:
    """Bits for a set: a power of two, at least 256, eight times the size of a small set and four times that of a large one."""
    return min(max(256, 1 << ((8 if n <= 256 else 4) * n - 1).bit_length()), 64 * BITS)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of fewer bits of the same set."""
    while len(bits) > words:
        half = len(bits) // 2
        bits = bits[:half] | bits[half:]
    return bits


def likely(one: tuple, two: tuple, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Whether leaves seem to link, by the size of their union as their bits tell it (linear counting)."""
    joint = np.bitwise_count(one[0][left] | two[0][right]).sum(1, dtype=np.int64)
    width = 64 * one[0].shape[1]
    union = -width * np.log(np.maximum(1 - joint / width, 0.5 / width))
    return 100 * (one[1][left] + two[1][right] - union) >= (percent - 3) * union


class Tree:
    """Signature tree over classes: levels of OR-ed bitmaps, size ranges, and sizes less bits (hidden overlap)."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.order = np.lexsort((*bits.T[:2], sizes))
        size, bit = sizes[self.order], bits[self.order]
        hidden = size - np.bitwise_count(bit).sum(1, dtype=np.int64)
        self.levels = [(bit, size, size, hidden)]
        while len(self.levels[-1][1]) > 1:
            b, low, high, h = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                                np.maximum.reduceat(h, at)))

    def meet(self, other: Tree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of leaves (positions in the classes of each tree) that may link, and which seem to, in batches."""
        top = max(len(self.levels), len(other.levels)) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        same = self is other
        while stack:
            level, left, right = stack.pop()
            one, two = self.levels[min(level, len(self.levels) - 1)], other.levels[min(level, len(other.levels) - 1)]
            (bl, ll, hl, xl), (br, lr, hr, xr) = ([x[left] for x in one], [x[right] for x in two])
            common = np.bitwise_count(bl & br).sum(1, dtype=np.int64)
            most = np.minimum(np.minimum(xl, xr) + common, np.minimum(hl, hr))
            keep = most >= need(ll, lr, percent)
            left, right = left[keep], right[keep]
            if level == 0:
                if same:
                    keep = left < right
                    left, right = left[keep], right[keep]
                if len(left):
                    yield self.order[left], other.order[right], likely(one, two, left, right, percent)
                continue
            if not len(left):
                continue

            def down(x: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
                if level > len(tree.levels) - 1:
                    return x[:, None], np.ones((len(x), 1), bool)
                child = x[:, None] * FAN + np.arange(FAN)
                return child, child < len(tree.levels[level - 1][1])

            (a, ok_a), (b, ok_b) = down(left, self), down(right, other)
            ok = ok_a[:, :, None] & ok_b[:, None, :]
            if same:
                ok &= a[:, :, None] <= b[:, None, :]
            left = np.broadcast_to(a[:, :, None], ok.shape)[ok]
            right = np.broadcast_to(b[:, None, :], ok.shape)[ok]
            step = max(FAN, min(8192, STEP // bl.shape[1]))
            for k in range(0, len(left), step):
                stack.append((level - 1, left[k:k + step], right[k:k + step]))


def trees(sizes: np.ndarray, bits: list[np.ndarray]) -> list[tuple[Tree, np.ndarray]]:
    """A tree for each length of bitmap, shortest first, with the positions of its classes."""
    lengths = np.array([len(b) for b in bits])
    return [(Tree(sizes[at], np.stack([bits[i] for i in at])), at) for n in np.unique(lengths) for at in [np.flatnonzero(lengths == n)]]


def meetings(sizes: np.ndarray, bits: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, percent: int):
    """Pairs of positions that may link, within ``left`` or between ``left`` and ``right``."""
    forests = [trees(sizes[left], [bits[i] for i in left])]
    forests.append(forests[0] if right is None else trees(sizes[right], [bits[i] for i in right]))
    names = [left, left if right is None else right]
    for i, (a, at_a) in enumerate(forests[0]):
        for j, (b, at_b) in enumerate(forests[1]):
            if right is None and j < i:
                continue
            size_a, size_b = sizes[names[0][at_a]], sizes[names[1][at_b]]
            if min(size_a.max(), size_b.max()) < need(size_a.min(), size_b.min(), percent):
                continue
            one, two = a, b
            if one is not two:
                words = min(len(one.levels[0][0][0]), len(two.levels[0][0][0]))
                if len(one.levels[0][0][0]) > words:
                    one = Tree(size_a, np.stack([fold(bits[k], words) for k in names[0][at_a]]))
                if len(two.levels[0][0][0]) > words:
                    two = Tree(size_b, np.stack([fold(bits[k], words) for k in names[1][at_b]]))
            for x, y, sure in one.meet(two, percent):
                yield names[0][at_a[x]], names[1][at_b[y]], sure


def spanning(sizes: np.ndarray, bits: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs that seem to link, no more than span the groups they form."""
    root, found = np.arange(len(sizes)), []
    for x, y, sure in meetings(sizes, bits, np.arange(len(sizes)), None, percent):
        apart = np.flatnonzero(sure & (root[x] != root[y]))
        while len(apart):
            i, j = int(x[apart[0]]), int(y[apart[0]])
            found.append((i, j))
            root[root == root[i]] = root[j]
            apart = apart[1:]
            apart = apart[root[x[apart]] != root[y[apart]]]
    return found


def _prefix(shingles: np.ndarray, hot: np.ndarray, percent: int) -> np.ndarray:
    n = len(shingles)
    keep = n - -(-percent * n // 100) + 1
    if len(hot):
        at = np.minimum(np.searchsorted(hot, shingles), len(hot) - 1)
        late = hot[at] == shingles
        shingles = np.concatenate((shingles[~late], shingles[late]))
    return shingles[:keep]


def join(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, set_key (equal for equal sets, null if empty), component_id."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def outline(hot: np.ndarray):
        def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                sets = shingle_sets(list(batch.text), k)
                yield pd.DataFrame({
                    "doc_id": batch.doc_id.astype("Int64"), "n_shingles": [len(s) for s in sets],
                    "set_key": [_key(s) if len(s) else None for s in sets],
                    "bits": [bitmap(s, width_for(len(s))).tobytes() if len(s) else b"" for s in sets],
                    "prefix": [_prefix(s, hot, percent).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]})
        return make

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [_NONE]
        for batch in batches:
            found += [_prefix(s, _NONE, percent) for s in shingle_sets(list(batch.text), k) if len(s)]
        tokens, n = np.unique(np.concatenate(found), return_counts=True)
        again = n > 1      # what a task sees once is not among the most frequent, and any order is exact
        yield pd.DataFrame({"token": tokens[again].view(np.int64), "n": n[again]})

    often = (narrow.select("text").mapInPandas(heads, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
             .where(F.col("n") >= HOT_COUNT).orderBy(F.desc("n"), "token").limit(HOT).collect())
    hot = np.sort(np.array([r.token for r in often], np.int64).view(np.uint64))
    rows = stage(narrow.mapInPandas(outline(hot), "doc_id long, n_shingles long, set_key binary, bits binary, prefix array<long>"), "outlines")

    filled = rows.where("n_shingles > 0")
    prefixes = filled.groupBy("set_key").agg(F.first("prefix").alias("prefix")).select("set_key", F.posexplode("prefix").alias("place", "token"))
    token = Window.partitionBy("token")
    shared = prefixes.withColumns({"k1": F.min("set_key").over(token), "k2": F.max("set_key").over(token)}).where("k1 <> k2")
    postings = stage(shared.select("token", "set_key", "place"), "postings")
    maps = filled.groupBy("set_key").agg(F.first("n_shingles").alias("size"), F.first("bits").alias("bits"))

    # most classes link within the groups of their smallest and largest shared shingle
    own = postings.groupBy("set_key").agg(F.array_distinct(F.array(F.min("token"), F.max("token"))).alias("tokens"))
    own = stage(own.select("set_key", F.explode("tokens").alias("token")), "own")
    crowd = own.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = own.join(crowd, "token").withColumn("block", F.pmod(F.xxhash64("set_key"), F.ceil(F.col("n") / F.lit(BLOCK)))).join(maps, "set_key")
    near = map_groups(own.select("token", "block", "set_key", "size", "bits"), ["token", "block"], _span(percent), "a binary, b binary")
    edges = stage(_verified(narrow, near.distinct(), k, percent), "near")
    roots = components(edges)

    # what still meets are different components; blocks of one shingle meet block by block
    classes = filled.groupBy("set_key").agg(F.first("n_shingles").alias("size"))
    named = stage(postings.join(classes, "set_key").join(roots, F.col("set_key") == F.col("node"), "left").select(
        "token", "set_key", F.coalesce("root", "set_key").alias("root"), "size", (F.col("size") - F.col("place")).alias("most")), "named")
    mark = F.xxhash64("set_key")
    mixed = named.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("r1"), F.max("root").alias("r2"), F.bit_xor(mark).alias("m1"),
                                       F.sum(mark.cast("decimal(38,0)")).alias("m2"), F.sum("most").alias("most")).where("r1 <> r2")
    # shingles with the same classes (a passage has many) meet once, at the first of them
    mixed = mixed.groupBy("n", "r1", "r2", "m1", "m2").agg(F.max_by("token", F.struct("most", "token")).alias("token"))
    mixed = stage(mixed.select("token", "n", F.monotonically_increasing_id().alias("id")), "mixed")

    def blocks(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("blocks", F.ceil(F.col("n") / F.lit(BLOCK))).withColumn("own", F.pmod(F.xxhash64("set_key"), F.col("blocks")))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        return rows.withColumns({"one": F.least("own", "other"), "two": F.greatest("own", "other")}).drop("blocks", "other")

    open_ = named.join(mixed, "token").drop("token").withColumnRenamed("id", "token")
    met = map_groups(blocks(open_), ["token", "one", "two"], _reach(percent), "token long, set_key binary, root binary, n long")
    open_ = blocks(stage(met.distinct(), "open")).drop("n")
    # a pair counts where its smallest common shingle is, so it comes out once
    lists = open_.groupBy("set_key").agg(F.sort_array(F.collect_set("token")).alias("tokens"))
    pairs = map_groups(open_.join(maps, "set_key").join(lists, "set_key"), ["token", "one", "two"], _may_link(percent), "a binary, b binary")
    more = _verified(narrow, pairs.distinct(), k, percent)
    roots = components(stage(edges.unionByName(more), "links"))

    named_classes = filled.groupBy("set_key").agg(F.min("doc_id").alias("low"))
    named_classes = named_classes.join(roots, F.col("set_key") == F.col("node"), "left").select(
        "set_key", "low", F.coalesce("root", "set_key").alias("root"))
    lowest = named_classes.groupBy("root").agg(F.min("low").alias("component_id"))
    final = named_classes.join(lowest, "root").select("set_key", "component_id")
    return rows.select("doc_id", "n_shingles", "set_key").join(final, "set_key", "left").select(
        "doc_id", "n_shingles", "set_key", F.coalesce("component_id", "doc_id").alias("component_id"))


_NONE = np.zeros(0, np.uint64)


def _key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _verified(narrow: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link, by their whole sets.

    A bitmap of fixed size keeps most sets that no pair asks for out of the shuffle; the join decides.
    """
    pairs = stage(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("set_key")).unionByName(pairs.select(F.col("b").alias("set_key"))).distinct()
    shared = sieve(wanted, "set_key")

    def full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shared.value
        for batch in batches:
            keys, packed = [], []
            for s in shingle_sets(list(batch.text), k):
                if len(s):
                    key = _key(s)
                    if in_sieve(bits, key):
                        keys.append(key)
                        packed.append(s.tobytes())
            yield pd.DataFrame({"set_key": keys, "shingles": packed})

    sets = narrow.select("text").mapInPandas(full, "set_key binary, shingles binary").groupBy("set_key").agg(F.first("shingles").alias("shingles"))
    sets = stage(sets.join(wanted, "set_key", "left_semi"), "sets")
    both = (pairs.join(sets.select(F.col("set_key").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(sets.select(F.col("set_key").alias("b"), F.col("shingles").alias("sb")), "b"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            links = []
            for one, two in zip(batch.sa, batch.sb, strict=True):
                x, y = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
                links.append(len(np.intersect1d(x, y, assume_unique=True)) >= need(len(x), len(y), percent))
            yield batch.loc[links, ["a", "b"]]

    return both.mapInPandas(check, "a binary, b binary")


def _span(percent: int):
    def span(group: dict[str, np.ndarray]) -> dict[str, list] | None:
        if len(group["set_key"]) < 2:
            return None
        keys, sizes, bits, _ = _classes(group)
        found = spanning(sizes, bits, percent)
        return {"a": [min(keys[i], keys[j]) for i, j in found], "b": [max(keys[i], keys[j]) for i, j in found]}
    return span


def _classes(group: dict[str, np.ndarray]):
    """Keys in order, sizes, bitmaps, and the order taken."""
    order = sorted(range(len(group["set_key"])), key=group["set_key"].__getitem__)
    keys = [group["set_key"][i] for i in order]
    return keys, group["size"][order], [np.frombuffer(group["bits"][i], np.uint64) for i in order], order


def reaching(sizes: np.ndarray, most: np.ndarray, roots: np.ndarray, percent: int) -> np.ndarray:
    """Which classes could link with one of another root, if no two share more than the ``most`` of either."""
    out = np.zeros(len(sizes), bool)
    step = max(1, (1 << 20) // len(sizes))
    for k in range(0, len(sizes), step):
        at = slice(k, k + step)
        fits = need(sizes[at, None], sizes, percent) <= np.minimum(most[at, None], most)
        out[at] = (fits & (roots[at, None] != roots)).any(1)
    return out


def _reach(percent: int):
    def reach(group: dict[str, np.ndarray]) -> dict[str, list] | None:
        if len(group["set_key"]) < 2:
            return None
        names: dict[bytes, int] = {}
        roots = np.array([names.setdefault(r, len(names)) for r in group["root"]])
        if len(names) < 2:
            return None
        at = np.flatnonzero(reaching(group["size"], group["most"], roots, percent))
        return {c: list(group[c][at]) for c in ("token", "set_key", "root", "n")} if len(at) else None
    return reach


def _may_link(percent: int):
    def may(group: dict[str, np.ndarray]) -> dict[str, list] | None:
        one, two = int(group["one"][0]), int(group["two"][0])
        if len(group["set_key"]) < 2 or len(set(group["root"])) < 2:
            return None
        keys, sizes, bits, order = _classes(group)
        root = np.unique([group["root"][i] for i in order], return_inverse=True)[1]
        own, token = group["own"][order], int(group["token"][0])
        lists = [set(group["tokens"][i].tolist()) for i in order]

        def here(i: int, j: int) -> bool:
            return min(lists[i] & lists[j]) == token

        if len(keys) <= FAN and one == two:      # a leaf of the tree meets itself
            a, b = [], []
            for i in range(len(keys)):
                for j in range(i):
                    least = need(int(sizes[i]), int(sizes[j]), percent)
                    if root[i] == root[j] or min(sizes[i], sizes[j]) < least:
                        continue
                    words = min(len(bits[i]), len(bits[j]))
                    x, y = fold(bits[i], words), fold(bits[j], words)
                    common = int(np.bitwise_count(x & y).sum())
                    hidden = min(sizes[i] - int(np.bitwise_count(x).sum()), sizes[j] - int(np.bitwise_count(y).sum()))
                    if hidden + common >= least and here(i, j):
                        a.append(keys[j])
                        b.append(keys[i])
            return {"a": a, "b": b}
        left, right = np.flatnonzero(own == one), None if one == two else np.flatnonzero(own == two)
        a, b = [], []
        if len(left) and (right is None or len(right)):
            for x, y, _ in meetings(sizes, bits, left, right, percent):
                apart = root[x] != root[y]
                for i, j in zip(np.minimum(x, y)[apart].tolist(), np.maximum(x, y)[apart].tolist(), strict=True):
                    if here(i, j):
                        a.append(keys[i])
                        b.append(keys[j])
        return {"a": a, "b": b}
    return may


def report(docs: DataFrame) -> DataFrame:
    return join(docs).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with the document of smallest doc_id of each component; texts without a word all stay.

    Of rows equal in doc_id and text one stays; rows of one doc_id with different texts are not told apart as to the id.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    kept = join(docs, k, percent).where("n_shingles > 0 and doc_id <=> component_id").select(name.alias("_keep_id")).distinct()
    has_word = F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    filled = docs.where(has_word).withColumn("_keep_id", name).join(kept, "_keep_id", "left_semi")
    return filled.dropDuplicates(["_keep_id", "text"]).select(*docs.columns).unionByName(docs.where(~has_word))

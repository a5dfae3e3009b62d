"""Removal of long repeated substrings with suffix arrays built by linear grouping.

A byte goes when a ``length``-byte string that covers it starts anywhere else too. The work is spread by anchors: of
every ``length`` consecutive bytes the gram (``GRAM`` bytes) with the smallest hash is the anchor, so equal strings have
their anchor at the same place, and each anchor owns a stretch of neighbouring starts. Anchors with equal grams meet:

* stretches whose whole context (all bytes their strings cover) is equal elsewhere are repeated as a whole;
* the different contexts of one gram, one of each kind, are aligned at the gram and cut where any two of them part; the
  pieces become symbols and the symbol strings go into one suffix array, whose neighbours have the longest common
  prefixes: a start is repeated when its prefix with a neighbour reaches ``length`` bytes. Every comparison is of bytes;
* where more than ``CROWD`` different contexts meet (common passages), their starts are dealt by distance from the gram into
  cells of ``FAN`` times fewer starts, and a cell's contexts meet by all bytes its strings have in common, a longer gram; equal
  ones are one again, the rest goes into suffix arrays or is dealt once more, until a cell is one start and its gram the string.

``suffix_array`` sorts suffixes in two passes. Groups of suffixes are taken in descending order; each finds the nearest
earlier suffix in a lower group (previous-smaller pointers), and those found move to new groups of their own, just above
their old ones, by how often they were found; in the end a group holds the suffixes with one longest Lyndon prefix. Then
one scan emits the order within groups: the suffix before an emitted one, and its previous-smaller ones, come next in
their groups. Nothing is renamed or sorted again.

Null text counts as empty; texts shorter than ``length`` lose nothing. Repeated rows are documents of their own and so
are removed whole from ``length`` bytes on. Results depend on texts, not on ids, so ids may be null or repeated; other columns
are ignored. An empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.common import map_groups
from tidebars.llm.shingles import mixed, powers
from tidebars.session import stage

LENGTH = 400
GRAM = 50
CROWD = 256            # different contexts in one suffix array
FAN = 8
FLUSH = 4096           # contexts handed on together
PIECE = 1 << 20        # starts looked at together; a longer text goes in overlapping pieces

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CODES = np.random.default_rng(4242).integers(1, 2**63, 256, dtype=np.uint64)


def suffix_array(s: list[int]) -> list[int]:
    """Starts of the suffixes of ``s`` in ascending order; a suffix sorts before the longer ones it begins."""
    n = len(s)
    order = sorted(range(n), key=s.__getitem__)      # suffixes by first symbol: the first groups
    place, group, end = [0] * n, [0] * n, [0] * n
    first = 0
    for k, i in enumerate(order):
        if k and s[i] != s[order[k - 1]]:
            first = k
        place[i], group[i], end[first] = k, first, k
    before = [-1] * n
    top = n - 1
    while top >= 0:
        low = group[order[top]]
        found = Counter()
        for i in sorted(order[low:top + 1]):
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = before[j]
            before[i] = j
            if j >= 0:
                found[j] += 1
        by_count = defaultdict(list)
        for j, often in found.items():
            by_count[often].append(j)
        for often in sorted(by_count, reverse=True):
            leaving = defaultdict(list)
            for j in by_count[often]:
                leaving[group[j]].append(j)
            for old, some in leaving.items():
                last = end[old]
                for j in some:      # to the end of the old group
                    e, p = end[old], place[j]
                    other = order[e]
                    order[p], order[e], place[other], place[j] = other, j, p, e
                    end[old] = e - 1
                new = end[old] + 1
                for j in some:
                    group[j] = new
                end[new] = last
        top = low - 1
    out, placed, front = [0] * n, [False] * n, {}
    for k in range(-1, n):
        j = (n if k < 0 else out[k]) - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            at = front.get(g, g)
            out[at], front[g], placed[j] = j, at + 1, True
            j = before[j]
    return out


def common_prefixes(s: list[int], order: list[int]) -> list[int]:
    """For each place in ``order`` the symbols it shares with the place before it."""
    rank = [0] * len(s)
    for k, i in enumerate(order):
        rank[i] = k
    out, h = [0] * len(s), 0
    for i, k in enumerate(rank):
        if k:
            j = order[k - 1]
            while i + h < len(s) and j + h < len(s) and s[i + h] == s[j + h]:
                h += 1
            out[k] = h
            h = max(0, h - 1)
        else:
            h = 0
    return out


def anchors(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text: their places, the first and last start each owns, and the hashes of their grams."""
    n_starts = len(data) - length + 1
    if n_starts < 1:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    parts = []
    for a in range(0, n_starts, PIECE):
        b = min(a + PIECE, n_starts)
        place, low, high, gram = _anchors(np.frombuffer(data, np.uint8)[a:b + length - 1], length)
        parts.append((place + a, low + a, high + a, gram))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all substrings of ``size`` bytes."""
    with np.errstate(over="ignore"):
        up = powers(len(data) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_CODES[data] * up[:-1], dtype=np.uint64)))
        down = powers(len(data) + 1, _BACK)[:len(sums) - size]
        return mixed((sums[size:] - sums[:-size]) * down)


def _anchors(data: np.ndarray, length: int):
    grams = _grams(data, GRAM)
    width = length - GRAM + 1
    places = np.arange(len(grams), dtype=np.uint64)
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - places)     # the last of equal grams wins
    done = 1
    while done < width:      # minima of windows, by doubling
        step = min(done, width - done)
        low = np.minimum(low[:-step], low[step:])
        done += step
    place = (np.uint64(0xFFFFFFFF) - (low & np.uint64(0xFFFFFFFF))).astype(np.int64)
    at = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.append(at[1:], len(place)) - 1
    return place[at], at, last, grams[place[at]]


def repeated_starts(contexts: list[bytes], at: list[int], low: list[int], high: list[int], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For different contexts aligned at a gram: the runs of starts (first, last) whose string is in another context too.

    A context begins at its first start; ``at`` is the gram's place in it, ``low`` and ``high`` its starts.
    """
    right = [c[a:] for c, a in zip(contexts, at, strict=True)]
    left = [c[:a][::-1] for c, a in zip(contexts, at, strict=True)]
    cuts_r, names_r = _refine(right)
    cuts_l, names_l = _refine(left)
    # symbols: pieces of the left from far to near, then of the right; a piece's name says which contexts agree so far
    base, string, owner = 2, [], []
    n_l, n_r = len(cuts_l) - 1, len(cuts_r) - 1
    for i in range(len(contexts)):
        for k in range(n_l - 1, -1, -1):
            string.append(base + (k * len(contexts) + names_l[i][k]) * 2)
        for k in range(n_r):
            string.append(base + (k * len(contexts) + names_r[i][k]) * 2 + 1)
        string.append(i - len(contexts))      # ends differ
        owner += [i] * (n_l + n_r + 1)
    order = suffix_array(string)
    shared = common_prefixes(string, order)
    sizes = [cuts_l[k + 1] - cuts_l[k] for k in range(n_l - 1, -1, -1)] + [cuts_r[k + 1] - cuts_r[k] for k in range(n_r)]
    until = [0]
    for size in sizes:
        until.append(until[-1] + size)
    width = n_l + n_r + 1
    best = [0] * len(string)
    for k, i in enumerate(order):
        best[i] = max(shared[k], shared[k + 1] if k + 1 < len(order) else 0)
    out = []
    for i, a in enumerate(at):
        runs = []
        for k in range(n_l + 1):      # the piece k of the left, or the gram's own place
            n = best[i * width + k]
            if not n or k + n <= n_l:
                continue
            first = a - cuts_l[n_l - k]
            last = a - cuts_l[n_l - k - 1] - 1 if k < n_l else a
            # a start inside a piece loses the bytes before it
            last = min(last, first + until[k + n] - until[k] - length, high[i])
            first = max(first, low[i])
            if first <= last:
                runs.append((first, last))
        out.append(runs)
    return out


def _refine(strings: list[bytes]) -> tuple[list[int], list[list[int]]]:
    """Places where strings part (with 0 and the longest end), and for each string and piece the class it is in so far."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    parts = []
    for x, y in zip(order, order[1:], strict=False):
        parts.append(_common(strings[x], strings[y]))
    cuts = sorted({0, *parts, max(map(len, strings))})
    names = [[0] * (len(cuts) - 1) for _ in strings]
    classes = [0] * (len(cuts) - 1)
    for k, i in enumerate(order):
        if k:
            for piece in range(len(classes)):
                if cuts[piece + 1] > parts[k - 1]:
                    classes[piece] = k
        names[i] = list(classes)
    return cuts, names


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = np.frombuffer(a[:n], np.uint8) != np.frombuffer(b[:n], np.uint8)
    return int(x.argmax())


def _outline(length: int):
    def outline(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, kinds, parts = [], [], []
            for text in batch.text:
                data = (text or "").encode("utf-8", "surrogatepass")
                if len(data) < length:
                    continue
                found = anchors(data, length)
                parts.append(found)
                keys += [hashlib.md5(data).digest()] * len(found[0])
                kinds += [_kind(data[a:b + length], p - a) for p, a, b in zip(*(x.tolist() for x in found[:3]), strict=True)]
            if parts:
                place, low, high, gram = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pd.DataFrame({"text_key": keys, "place": place, "low": low, "high": high, "gram": gram.view(np.int64), "kind": kinds})
    return outline


def _kind(context: bytes, at: int) -> bytes:
    return hashlib.blake2b(context, digest_size=12, salt=at.to_bytes(8, "little")).digest()


def _kinds(rows: DataFrame, *carried: str) -> tuple[DataFrame, DataFrame]:
    """The kinds of contexts (gram, kind, n, one of them, crowd) of grams with several rows, and the runs of those that are repeated whole."""
    kinds = rows.groupBy("gram", "kind").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("text_key", "place", "low", "high", *carried)).alias("one"))
    crowds = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("crowd"), F.sum("n").alias("all")).where("all > 1")
    kinds = stage(kinds.join(crowds, "gram"), "kinds")
    whole = rows.join(kinds.where("n > 1").select("gram", "kind"), ["gram", "kind"], "left_semi").select("text_key", "low", "high")
    return kinds, whole


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Runs of repeated starts: text_key, low, high."""
    rows = stage(docs.select("text").mapInPandas(_outline(length), "text_key binary, place long, low long, high long, gram long, kind binary"), "anchors")
    kinds, whole = _kinds(rows)

    # contexts of grams that have several
    wanted = kinds.where("crowd > 1").select("gram", "crowd", "one.*")
    lists = wanted.groupBy("text_key").agg(F.collect_list(F.struct("gram", "crowd", "place", "low", "high")).alias("wanted"))
    texts = docs.select("text").withColumn("text_key", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    texts = texts.join(lists, "text_key").dropDuplicates(["text_key"])
    names = ["gram", "crowd", "text_key", "place", "low", "high", "context"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text, some in zip(batch.text_key, batch.text, batch.wanted, strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for w in some:
                    out.append((w["gram"], w["crowd"], key, w["place"], w["low"], w["high"], data[w["low"]:w["high"] + length]))
                if len(out) >= FLUSH:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    contexts = stage(texts.mapInPandas(cut, "gram long, crowd long, text_key binary, place long, low long, high long, context binary"), "contexts")

    def sort(group: dict[str, np.ndarray]) -> dict[str, list] | None:
        low = group["low"]
        runs = repeated_starts(list(group["context"]), (group["place"] - low).tolist(), [0] * len(low), (group["high"] - low).tolist(), length)
        found = [(key, a + base, b + base) for key, base, own in zip(group["text_key"], low.tolist(), runs, strict=True) for a, b in own]
        return dict(zip(("text_key", "low", "high"), map(list, zip(*found, strict=True)), strict=True)) if found else None

    def few(contexts: DataFrame) -> DataFrame:
        return map_groups(contexts.where(F.col("crowd") <= CROWD), ["gram"], sort, "text_key binary, low long, high long")

    found = whole.distinct().unionByName(few(contexts))
    for width in _widths(length):
        crowded = contexts.where(F.col("crowd") > CROWD)
        if crowded.isEmpty():
            break
        rows = stage(crowded.mapInPandas(_deal(length, width), "gram long, kind binary, text_key binary, place long, low long, high long, context binary"), "dealt")
        kinds, whole = _kinds(rows, "context")
        contexts = stage(kinds.where("crowd > 1").select("gram", "crowd", "one.*"), "contexts")
        found = found.unionByName(whole).unionByName(few(contexts))
    return found


def _widths(length: int) -> list[int]:
    """Starts of a cell, dealing by dealing: powers of ``FAN`` below all starts that one anchor may own, down to 1."""
    out = [1]
    while out[0] * FAN < length - GRAM + 1:
        out.insert(0, out[0] * FAN)
    return out


def _deal(length: int, width: int):
    """Contexts cut into those of cells: of the starts ``width * cell`` and on, counted back from the gram."""
    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["gram", "kind", "text_key", "place", "low", "high", "context"]
        for batch in batches:
            out = []
            for key, place, low, high, context in zip(batch.text_key, batch.place.tolist(), batch.low.tolist(), batch.high.tolist(), batch.context, strict=True):
                for cell in range((place - high) // width, (place - low) // width + 1):
                    near, far = cell * width, min(cell * width + width - 1, length - GRAM)
                    first, last = max(low, place - far), min(high, place - near)
                    own = context[first - low:last - low + length]
                    shared = context[place - near - low:place - far - low + length]      # is in every string of the cell
                    gram = int.from_bytes(hashlib.blake2b(shared, digest_size=8, salt=cell.to_bytes(8, "little")).digest(), "little", signed=True)
                    out.append((gram, _kind(own, place - first), key, place, first, last, own))
                if len(out) >= FLUSH:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)
    return deal


def remove(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) for every row."""
    runs = repeats(docs, length).groupBy("text_key").agg(F.collect_list(F.struct("low", "high")).alias("runs"))
    keyed = docs.select("doc_id", "text").withColumn("text_key", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    joined = keyed.join(runs, "text_key", "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "runs")

    def drop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text, own in zip(batch.doc_id, batch.text, batch["runs"], strict=True):
                data, spans = (text or "").encode("utf-8", "surrogatepass"), []
                for a, b in sorted((r["low"], r["high"]) for r in own) if own is not None else ():
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b + length)
                    else:
                        spans.append([a, b + length])
                ends = [0, *(x for span in spans for x in span), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                out.append((doc, len(data), len(data) - len(kept), len(spans), kept))
            frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
            frame["doc_id"] = frame.doc_id.astype("Int64")
            yield frame

    return joined.mapInPandas(drop, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def report(docs: DataFrame) -> DataFrame:
    return remove(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

"""Packing token sequences: shortest-pack-first over the histogram of piece lengths.

A document becomes token ids and a closing id; ids are cut into full pieces of ``length`` and one rest. A full piece is
a sequence of its own. Rests are packed by their length histogram (``length - 1`` rows at most, whatever the
corpus): lengths are placed longest first, each into the packing pattern with the shortest filling that still takes it,
and only pattern counts are updated. Rests then meet the places of the patterns by their rank among rests of equal length.

Null text counts as empty and has the closing id only. Repeated rows are pieces of their own. An empty table gives
no pieces. Other columns are ignored.
"""
from __future__ import annotations

import base64
import functools
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.common import running_totals, tiles_for
from tidebars.session import stage

LENGTH = 1024
END = 0
MEMO = 100_000        # words remembered by a task

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Encoder:
    """Token ids as little-endian 32-bit bytes, word by word.

    Byte-level pairs never join across a blank that follows a non-blank, so a text is the ids of its words with their
    leading blank; equal words are encoded once while they are remembered. ``path`` is the vocabulary for tokenizers; with
    ``ranks`` (the same vocabulary as ranks) words are encoded by tiktoken, which gives the same ids in a sixth of the
    time. Texts with other white space before a blank are encoded whole, and those with a special token by tokenizers.
    """

    def __init__(self, path: str, ranks: str | None = None):
        self.path = path
        with open(path, encoding="utf-8") as file:
            self.special = [t["content"] for t in json.load(file)["added_tokens"]]
        self.memo: dict[str, bytes] = {}
        self.plain = None
        if ranks is not None:
            import tiktoken
            from public_tokenizers import PATTERN

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.plain = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary

    @functools.cached_property
    def tokenizer(self):
        """Loaded when the first text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, texts: list[str]) -> list[bytes]:
        if self.plain is not None:
            return [array("I", self.plain(t)).tobytes() for t in texts]
        return self.by_tokenizers(texts)

    def by_tokenizers(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        out = []
        for text in texts:
            if any(s in text for s in self.special):
                out += self.by_tokenizers([text])
                continue
            if _BLANKS.search(text):
                out += self.ids([text])
                continue
            first, *rest = text.split(" ")
            new = [w for w in set(rest) if w not in memo]
            memo.update(zip(new, self.ids([" " + w for w in new]), strict=True))
            out.append(self.ids([first])[0] + b"".join(map(memo.__getitem__, rest)))
        return out


_BLANKS = re.compile(r"\s ")


@functools.cache
def encoder(path: str, ranks: str | None) -> Encoder:
    """One for each worker process."""
    return Encoder(path, ranks)


def pieces(docs: DataFrame, path: str, ranks: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """Every document cut into pieces of ``length`` ids and a rest; the ids themselves stay in the task."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, closing = encoder(path, ranks), np.asarray([end], "<u4").tobytes()
        for batch in batches:
            texts = [t or "" for t in batch.text]
            rows = []
            step = 256
            for k in range(0, len(texts), step):
                for doc, ids in zip(batch.doc_id[k:k + step], coder.encode(texts[k:k + step]), strict=True):
                    ids += closing
                    n = len(ids) // 4
                    rows += [(doc, s, min(length, n - s), zlib.crc32(memoryview(ids)[4 * s:4 * (s + length)]), n)
                             for s in range(0, n, length)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        coder.memo.clear()      # a worker that is used again has the encoder, not the words

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInPandas(cut, PIECES)


def shortest_pack_first(counts: dict[int, int], length: int) -> list[tuple[list[int], int]]:
    """Packing patterns (lengths, how often) for ``counts`` by piece length; every piece is in one pattern."""
    open_packs: dict[int, list[list]] = {}      # by filling: [lengths, how often]
    done: list[tuple[list[int], int]] = []
    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            fill = next((f for f in sorted(open_packs) if f + n <= length), None)
            if fill is None:
                fit = length // n
                if left >= fit:
                    done_or_open, left = (([n] * fit, left // fit), left % fit)
                else:
                    done_or_open, left = (([n] * left, 1), 0)
                lengths, often = done_or_open
                _put(open_packs, done, lengths, often, length)
                continue
            lengths, often = open_packs[fill].pop()
            if not open_packs[fill]:
                del open_packs[fill]
            fit = min((length - fill) // n, max(1, left // often))
            used = min(often, left // fit)
            if used < often:
                open_packs.setdefault(fill, []).append([lengths, often - used])
            _put(open_packs, done, lengths + [n] * fit, used, length)
            left -= used * fit
    return done + [(lengths, often) for packs in open_packs.values() for lengths, often in packs]


def _put(open_packs, done, lengths, often, length) -> None:
    fill = sum(lengths)
    if fill == length:
        done.append((lengths, often))
    else:
        open_packs.setdefault(fill, []).append([lengths, often])


def pack(docs: DataFrame, path: str, ranks: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """Pieces of all documents with sequence_id and offset."""
    spark = docs.sparkSession
    cut = stage(pieces(docs, path, ranks, length, end), "pieces")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, n_full = sum(counts.values()), counts.pop(length, 0)
    order = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    ranked = running_totals(cut, ["length"], order, {"rank": F.lit(1)}, tiles_for(n))
    ranked = stage(ranked, "ranked")
    full = ranked.where(F.col("length") == length).withColumns({"sequence_id": F.col("rank"), "offset": F.lit(0).cast("long")})
    # places: pattern p repeats `often` times from sequence `base`; its lengths in slots take runs of ranks
    places, base, given = [], n_full, dict.fromkeys(counts, 0)
    for lengths, often in shortest_pack_first(counts, length):
        at = 0
        for size in lengths:
            places.append((size, given[size], given[size] + often, base, at))
            given[size] += often
            at += size
        base += often
    slots = spark.createDataFrame(places, "length long, low long, high long, base long, at long")
    rest = ranked.where(F.col("length") < length).withColumn("tile", F.expr(f"rank div {_TILE}"))
    slots = slots.withColumn("tile", F.explode(F.expr(f"sequence(low div {_TILE}, (high - 1) div {_TILE})")))
    rest = rest.join(slots, ["length", "tile"]).where("rank >= low and rank < high")
    rest = rest.withColumns({"sequence_id": F.col("base") + F.col("rank") - F.col("low"), "offset": F.col("at")})
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return full.select(out).unionByName(rest.select(out))


_TILE = 1_000_000     # ranks that one row of the places covers at most

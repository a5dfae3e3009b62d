"""Short codes for vectors: each part of a vector is replaced by the nearest entry of its position's codebook.

Codebooks come from Lloyd rounds over active entries. A part keeps the index of its entry and its exact squared distance from
round to round, in a staged table beside the vector. Where a part's entry did not move in the last update, that distance
still holds and no unmoved entry can have become nearer, so only moved entries are compared with it; other parts are compared
with all entries. Ties go to the lower index, also against an entry that stayed.

One pass over the vectors does a round: it assigns parts and adds one row per task with the sums and counts of the new
assignment, from which the driver makes the next codebooks (entries x dimension numbers, whatever the number of vectors).
Nothing is shuffled but those sums and, at the end, one narrow row per vector.

All arithmetic is on integers floor(scale * x). Vectors that are null or hold a null or a non-finite component are dropped, and so
are those whose length differs from that of the vector with the smallest id (nulls last). Lengths that the number of parts does not
divide give parts that differ by one. Components are held to a limit (32768 for 64 of them at scale 4096) beyond which squared
distances would not fit a long. Fewer vectors than entries give smaller codebooks; repeated rows and repeated ids count as often as
they come. An empty table gives no rows. Null labels are one label; other columns are ignored.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.session import stage

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
EXACT = 1 << 53      # whole numbers below it are exact as doubles


class Codes(NamedTuple):
    """``assigned``: id, label, code (a byte per part) and error per vector; ``books``: per part an array of entries by components."""
    assigned: DataFrame
    books: list[np.ndarray]


def whole_vectors(df: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> tuple[DataFrame, int]:
    """Rows (vec_id, label, x) with whole components, and their length."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = df.where(x.isNotNull() & ~bad)
    first = good.agg(F.min(F.struct(F.col(vec_id).isNull().alias("none"), F.col(vec_id).alias("id"), F.size(x).alias("n"))).alias("v")).first().v
    n = first.n if first is not None else 0
    limit = math.isqrt((1 << 62) // max(n, 1)) // 2
    scaled = F.transform(x, lambda v: F.greatest(F.lit(-limit), F.least(F.lit(limit), F.floor(v.cast("double") * scale))).cast("long"))
    return good.where(F.size(x) == n).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), scaled.alias("x")), n


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows by entries; by a product of matrices where doubles hold every term."""
    largest = int(np.abs(x).max(initial=0)) + int(np.abs(entries).max(initial=0))
    if largest * largest * max(1, x.shape[1]) < EXACT:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return ((x[:, None, :] - entries[None]) ** 2).sum(2)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = distances(x, entries)
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at]


def reassign(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray, dist: np.ndarray) -> None:
    """One part position: brings ``code`` and ``dist`` (in place) up to date with entries of which some moved."""
    active = np.flatnonzero(moved)
    if not len(active):
        return
    lost = moved[code]
    if lost.any():
        code[lost], dist[lost] = nearest(x[lost], entries)
    held = np.flatnonzero(~lost)
    at, d = nearest(x[held], entries[active])
    at = active[at]
    better = (d < dist[held]) | ((d == dist[held]) & (at < code[held]))
    code[held[better]], dist[held[better]] = at[better], d[better]


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def assign(df: DataFrame, cuts: list[int], books: list[np.ndarray], moved: list[np.ndarray] | None) -> DataFrame:
    """Rows with code and dist after one assignment (the first if ``moved`` is None), and rows with ``sums`` and ``used`` alone."""
    parts, k, n = len(cuts) - 1, len(books[0]), cuts[-1]
    spans = list(zip(cuts, cuts[1:]))
    kinds = dict(df.dtypes)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, x array<bigint>, code binary, dist array<bigint>, sums array<bigint>, used array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, used = [np.zeros((k, b - a), np.int64) for a, b in spans], np.zeros((parts, k), np.int64)
        out = None
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            x = _numbers(batch.column("x"), n)
            if moved is None:
                code, dist = np.zeros((rows, parts), np.int64), np.zeros((rows, parts), np.int64)
            else:
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(rows, parts).astype(np.int64)
                dist = _numbers(batch.column("dist"), parts).copy()
            for p, (a, b) in enumerate(spans):
                part = x[:, a:b]
                if moved is None:
                    code[:, p], dist[:, p] = nearest(part, books[p])
                else:
                    reassign(part, books[p], moved[p], code[:, p], dist[:, p])
                own = code[:, p] == np.arange(k)[:, None]
                used[p] += own.sum(1)
                # a batch's sums stay far below 2**53
                sums[p] += (own.astype(np.float64) @ part.astype(np.float64)).astype(np.int64)
            codes = code.astype(np.uint8)
            out = pa.RecordBatch.from_arrays([
                batch.column("vec_id"), batch.column("label"), batch.column("x"), pa.array([r.tobytes() for r in codes], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(0, rows * parts + 1, parts), pa.int32()), pa.array(dist.ravel())),
                pa.nulls(rows, pa.list_(pa.int64())), pa.nulls(rows, pa.list_(pa.int64()))],
                names=["vec_id", "label", "x", "code", "dist", "sums", "used"])
            yield out
        if out is not None:
            total = np.concatenate([s.ravel() for s in sums]).tolist()
            yield pa.RecordBatch.from_arrays([
                pa.nulls(1, out.column("vec_id").type), pa.nulls(1, out.column("label").type), pa.nulls(1, out.column("x").type),
                pa.nulls(1, pa.binary()), pa.nulls(1, pa.list_(pa.int64())),
                pa.array([total], pa.list_(pa.int64())), pa.array([used.ravel().tolist()], pa.list_(pa.int64()))], names=out.schema.names)

    return df.mapInArrow(run, schema)


def _totals(rows: DataFrame, column: str) -> list[int]:
    """Sums of arrays, place by place; their length is that of one set of codebooks."""
    found = rows.where(F.col(column).isNotNull()).select(F.posexplode(column)).groupBy("pos").agg(F.sum("col").alias("s")).collect()
    out = [0] * len(found)
    for r in found:
        out[r.pos] = r.s
    return out


def updated(books: list[np.ndarray], sums: list[int], used: list[int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Entries at the floor of their parts' mean, and which of them moved; an entry without parts stays."""
    k, at, new = len(books[0]), 0, []
    for p, book in enumerate(books):
        book = book.copy()
        for e in range(k):
            n, width = used[p * k + e], book.shape[1]
            if n:
                book[e] = [s // n for s in sums[at:at + width]]
            at += width
        new.append(book)
    return new, [(a != b).any(1) for a, b in zip(new, books)]


def encode(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
           entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes | None:
    """Codebooks from the vectors of the smallest ids and ``rounds`` rounds over all, then a last assignment; None without vectors.

    Seeds of equal ids are ordered by their components; null ids come last.
    """
    now, n = whole_vectors(df, vec_id, vector, label, scale)
    seeds = [r.x for r in now.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()]
    if not seeds:
        return None
    cuts = [i * n // parts for i in range(parts + 1)]
    start = np.array(seeds, np.int64).reshape(len(seeds), n)
    books, moved = [start[:, a:b] for a, b in zip(cuts, cuts[1:])], None
    for _ in range(rounds):
        rows = stage(assign(now, cuts, books, moved), "vector_codes")
        books, moved = updated(books, _totals(rows, "sums"), _totals(rows, "used"))
        now = rows.where("x is not null").select("vec_id", "label", "x", "code", "dist")
    last = assign(now, cuts, books, moved).where("x is not null")
    error = F.aggregate("dist", F.lit(0).cast("long"), lambda a, b: a + b)
    return Codes(last.select("vec_id", "label", "code", error.alias("error")), books)


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for entry in book.tolist() for v in entry).encode()).hexdigest()


def report(embeddings: DataFrame) -> DataFrame:
    """One row per kept vector; ``label_error`` is null where a label's sum does not fit a long."""
    kinds = dict(embeddings.dtypes)
    found = encode(embeddings.select("vec_id", "embedding", "label"))
    if found is None:
        return embeddings.sparkSession.createDataFrame(
            [], f"vec_id {kinds['vec_id']}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    rows = stage(found.assigned.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error"), "vector_code_rows")
    totals = rows.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    return rows.join(totals, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(found.books)).alias("codebooks_sha256"))

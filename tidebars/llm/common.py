"""Helpers shared by the operators of this package."""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebars.session import stage

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACES = "' \\t\\n\\u000b\\f\\r'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tiles_for(n: int, rows: int = 100_000) -> int:
    """So many tiles that each holds about ``rows`` rows, hot keys included."""
    return max(8, math.ceil(n / rows))


def running_totals(df: DataFrame, keys: list[str], order: list[str], weights: dict[str, Column], tiles: int,
                   first: Column | None = None) -> DataFrame:
    """Adds exclusive running totals of ``weights`` within ``keys``, without a key in one task.

    The order within a key is ``first`` (a small number, lower first), then a hashed tile, then ``order``.
    Rows of a tile are ordered in one task; the totals of tiles are summed apart and joined back. ``df`` must give
    the same rows each time (a staged table). Key columns must not be null.
    """
    df = df.withColumn("_tile", F.pmod(F.xxhash64(*order), F.lit(tiles)))
    df = df.withColumn("_first", F.lit(0) if first is None else first)
    near = [*keys, "_first", "_tile"]
    inside = Window.partitionBy(*near).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("_first", "_tile").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*near).agg(*(F.sum(w).alias(f"_sum_{n}") for n, w in weights.items()))
    sums = sums.select(*near, *(F.coalesce(F.sum(f"_sum_{n}").over(across), F.lit(0)).alias(f"_before_{n}") for n in weights))
    out = df.withColumns({f"_in_{n}": F.coalesce(F.sum(w).over(inside), F.lit(0)) for n, w in weights.items()})
    out = out.join(sums, near)
    out = out.withColumns({n: F.col(f"_before_{n}") + F.col(f"_in_{n}") for n in weights})
    return out.drop("_tile", "_first", *(f"_{p}_{n}" for p in ("in", "before") for n in weights))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): rows (node, root), root the smallest node reachable.

    Alternating stars: each round hangs the larger neighbours of a node, then its smaller ones, on the smallest
    neighbour; a written table cuts the lineage. Ends when a round changes nothing. Nodes without edges are absent.
    """
    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        if larger:
            both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        return down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b")))

    now = stage(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                .distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen:
            break
        seen = mark
        now = stage(star(star(now, True), False).where("a <> b").distinct(), "star")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root")))


SIEVE = 24       # bits of a key in the fixed bitmap (2 MB)


def sieve(keys: DataFrame, column: str) -> Broadcast:
    """A bitmap of fixed size of hashed binary ``keys``; ``in_sieve`` tells keys that are surely not among them.

    It keeps rows that nothing asks for out of a shuffle; a join must decide. Full, it lets everything through.
    """
    at = F.conv(F.hex(F.substring(column, 1, SIEVE // 8)), 16, 10).cast("long") + 1     # buckets are numbered from 1
    parts = (keys.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("part"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect())
    bits = np.zeros((1 << SIEVE) // 8, np.uint8)
    for r in parts:      # 2**15 bits each
        bits[(r.part - 1) * 4096:r.part * 4096] |= np.frombuffer(bytes(r.bits), np.uint8)
    return keys.sparkSession.sparkContext.broadcast(bits)


def in_sieve(bits: np.ndarray, key: bytes) -> bool:
    at = int.from_bytes(key[:SIEVE // 8])
    return bool(bits[at >> 3] >> (at & 7) & 1)


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[dict[str, np.ndarray]], dict[str, list] | None], schema: str) -> DataFrame:
    """``fn`` over the rows of each key, given and returned as columns, in one stream per partition: small groups are cheap.

    The caller bounds the size of a group. ``fn`` may return None for no rows.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: dict[str, np.ndarray] | None = None
        for batch in batches:
            rows = {c: batch[c].to_numpy() for c in batch}
            if rest is not None:
                rows = {c: np.concatenate((rest[c], rows[c])) for c in rows}
            new = np.zeros(len(rows[keys[0]]), bool)
            for key in keys:
                new[1:] |= rows[key][1:] != rows[key][:-1]
            at = [0, *np.flatnonzero(new).tolist()]
            yield from results(rows, at)
            rest = {c: x[at[-1]:] for c, x in rows.items()}
        if rest is not None and len(rest[keys[0]]):
            yield from results(rest, [0, len(rest[keys[0]])])

    def results(rows: dict[str, np.ndarray], at: list[int]) -> Iterator[pd.DataFrame]:
        out: dict[str, list] = {c: [] for c in names}
        for a, b in zip(at, at[1:], strict=False):
            found = fn({c: x[a:b] for c, x in rows.items()})
            if found is not None:
                for c in names:
                    out[c] += found[c]
        if out[names[0]]:
            yield pd.DataFrame(out)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(stream, schema)

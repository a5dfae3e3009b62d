"""Mixing sources to target weights by fitting a budget of words per source.

Sources share ``share`` times all words by weight; no source goes beyond ``most`` times its own words, and what is cut
off is shared again by weight. Within a source, documents are counted by exact length: every document is taken
``floor(target / words)`` times, and a bounded knapsack over the length counts picks which lengths are taken once more,
so that the words taken meet the target exactly where lengths allow, else fall short by the least the search finds.
Documents of a length are chosen by a seeded hash, so reruns agree.

Null or blank text has no words and is never taken; the null source is the last of the sources. Repeated rows are
rows of their own. An empty table gives an empty result. Extra columns are kept. The histogram is one row per source
and exact length; its rows for one source are fitted in one task and grow with the square root of its words at most.
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.llm.common import SPACE, running_totals, tiles_for
from tidebars.session import stage

WEIGHTS = (3.0, 1.0, 2.0)   # by rank of the source, repeating
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"
DP_WORDS = 1 << 21          # budget left to the knapsack at most; before it, lengths are taken in proportion


def n_words(text: Column) -> Column:
    """Number of maximal runs of characters other than blank, tab, line feed, vertical tab, form feed, return."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")
    flat = F.btrim(flat, F.lit(" "))
    spaces = F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit("")))
    return F.when(flat == "", F.lit(0)).otherwise(spaces + 1).cast("long")


def fit_lengths(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take, ``0 <= take <= count``, so that the sum is ``budget`` or just below it.

    Each length first gives its proportional part (rounded down), then long lengths give more while more than
    ``DP_WORDS`` is missing; short lengths give some back, and a bounded knapsack over the remaining counts, shortest
    lengths first, fits the rest.
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    take = [c * budget // total if total else 0 for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, take, strict=True))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:
        more = min(counts[i] - take[i], max(0, left - DP_WORDS) // lengths[i])
        take[i] += more
        left -= more * lengths[i]
    top = max(lengths, default=0)
    for i in order:      # one word more or less is decided by short lengths, so long ones go first here too
        if left <= 4 * top:
            break
        more = min(counts[i] - take[i], (left - 2 * top) // lengths[i])
        if more > 0:
            take[i] += more
            left -= more * lengths[i]
    # short lengths give back some of their part, so that the knapsack has a choice
    room = min(DP_WORDS, max(4 * top, 1 << 14))
    for i in reversed(order):
        back = min(take[i], max(0, room - left) // lengths[i])
        take[i] -= back
        left += back * lengths[i]
    reach, steps, mask = 1, [], (1 << (left + 1)) - 1
    for i in reversed(order):
        free, part = min(counts[i] - take[i], left // lengths[i]), 1
        while free > 0 and not (reach >> left) & 1:
            part = min(part, free)
            steps.append((i, part, reach))
            reach |= (reach << (lengths[i] * part)) & mask
            free, part = free - part, part * 2
        if (reach >> left) & 1:
            break
    at = reach.bit_length() - 1
    for i, part, before in reversed(steps):
        if not (before >> at) & 1:
            take[i] += part
            at -= lengths[i] * part
    return take


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Adds ``target`` to one row per source (source, source_size), the null source last in rank.

    Sources are ranked over ranges of their names; capped sources are found by rounds of sums over all sources.
    """
    staged = stage(sizes.withColumn("last", F.col("source").isNull().cast("int"))
                   .repartitionByRange(8, "last", "source").withColumn("part", F.spark_partition_id()), "sources")
    ranked = running_totals(staged.withColumns({"k": F.lit(0), "name": F.coalesce("source", F.lit(""))}), ["k"], ["last", "name"],
                            {"rank": F.lit(1)}, 1, F.col("part"))
    names = list(weights)
    weight = F.element_at(F.array(*map(F.lit, names)), (F.col("rank") % len(names) + 1).cast("int"))
    table = stage(ranked.select("source", "source_size", weight.alias("weight"),
                                (F.col("source_size") * most).alias("cap")), "weights")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:      # each round caps more sources or ends
        over = F.col("cap") <= F.col("weight") * level
        capped, free, left = table.agg(F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight"))),
                                       F.count(F.when(~over, 1))).first()
        if not left:
            break
        new = max(level, (share * total - (capped or 0.0)) / free)
        if new == level:
            break
        level = new
    return table.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.lit(level)).alias("target"))


def mix(docs: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS,
        seed: str = SEED) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) as (doc_id, size, source, source_size, target, taken, row_hash)."""
    sized = stage(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), row_hash(docs).alias("row_hash")), "sizes")
    n = sized.count()
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = stage(targets(per_source, share, most, weights), "targets")
    histogram = sized.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    histogram = histogram.alias("h").join(goals.alias("g"), F.expr("h.source <=> g.source")).select(
        "h.source", "size", "n", "source_size", "target")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        words, goal = int(group.source_size.iloc[0]), round(float(group.target.iloc[0]))
        whole = goal // words
        more = fit_lengths(group["size"].tolist(), group.n.tolist(), goal - whole * words)
        return pd.DataFrame({"source": group.source, "size": group["size"], "whole": whole, "more": more})

    plan = histogram.groupBy("source").applyInPandas(fit, "source string, size long, whole long, more long")
    plan = stage(plan, "plan")
    keyed = sized.withColumns({"skey": F.coalesce("source", F.lit("")), "snull": F.col("source").isNull().cast("int"),
                               "draw": F.xxhash64(F.lit(seed), "doc_id", "row_hash")})
    ranked = running_totals(keyed, ["snull", "skey", "size"], ["draw", "doc_id", "row_hash"], {"rank": F.lit(1)}, tiles_for(n))
    out = (ranked.alias("d").join(goals.alias("g"), F.expr("d.source <=> g.source"))
           .join(plan.alias("p"), F.expr("d.source <=> p.source and d.size = p.size"), "left"))
    taken = F.coalesce(F.col("p.whole") + (F.col("d.rank") < F.col("p.more")).cast("long"), F.lit(0)).cast("long")
    return out.select("d.doc_id", "d.size", "d.source", "g.source_size", "g.target", taken.alias("taken"), "d.row_hash")


def report(docs: DataFrame) -> DataFrame:
    """``taken`` in words, repeats counted, as ``target`` is; ``mix`` and ``repeat`` count copies."""
    words = (F.col("size") * F.col("taken")).cast("long")
    return mix(docs).select("doc_id", "size", "source_size", "target", words.alias("taken"))


def row_hash(docs: DataFrame) -> Column:
    """A hash of the whole row (maps left out); rows that share it and their doc_id are taken as repeats of one row."""
    return F.xxhash64(*(f"`{c}`" for c, kind in docs.dtypes if "map<" not in kind and kind != "void"))


def repeat(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them; repeated rows share what they take together."""
    def key(hashed: Column) -> Column:
        return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), hashed.cast("string")).alias("_mix_key")

    takes = mix(docs).select(key(F.col("row_hash")), "taken").groupBy("_mix_key").agg(F.sum("taken").alias("_takes")).where("_takes > 0")
    rows = docs.withColumn("_mix_key", key(row_hash(docs))).join(takes, "_mix_key").dropDuplicates(["_mix_key"])
    return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_takes"))).alias("_i")).drop("_i")

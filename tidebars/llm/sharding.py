"""Shards of equal row counts by balanced label propagation, in built-in SQL functions only.

Rows with equal texts are linked. A group of a quota or more takes whole shards first; what is left of it, and all other rows, start
in a hashed one of the other shards. In every round each group of linked rows moves towards the shard with room that holds most of
it, within that room, larger groups first; its rows in full shards move as well, and leave room there. Rows of one group in one
shard are interchangeable, so rounds, which end when one changes nothing (or after ``ROUNDS``), join and sum cells (group, shard, rows), never pairs. At last each shard keeps
its quota, linked rows first, and the rows beyond it fill the shards that have room: counts differ by one at most
(law ``rows``). A group beyond a quota lies in one shard more than it fills; a smaller one is cut only where no shard has room for
all of it, which befalls the last few.

Null text has no bytes (size 8, crc 0) and null texts are one group. Repeated rows are rows of their own. An empty table gives
an empty result. Other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.common import running_totals, tiles_for
from tidebars.session import stage

SHARDS = 24
ROUNDS = 6      # of propagation; most groups are whole after two or three


def propagate(cells: DataFrame, cap: int, tiles: int) -> DataFrame:
    """One round over ``cells`` (g, shard, n): movers go to the fullest open shard of their group while it has room."""
    load = {r.shard: r.n for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}    # one row a shard
    closed = [s for s, n in load.items() if n >= cap]
    open_ = ~F.col("shard").isin(closed) if closed else F.lit(True)
    best = cells.where(open_).groupBy("g").agg(F.max(F.struct("n", (-F.col("shard")).alias("s"))).alias("m"), F.sum("n").alias("size"))
    cells = cells.join(best.select("g", (-F.col("m.s")).alias("goal"), "size"), "g", "left")
    # rows in a full shard leave it, unless they fill it
    leaves = F.col("goal").isNotNull() & (open_ | (F.col("n") < cap))
    cells = stage(cells.withColumn("goal", F.when(leaves, F.col("goal")).otherwise(F.col("shard"))), "goals")
    stays = {r.shard: r.n for r in cells.where("goal = shard").groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    movers = cells.where("goal <> shard")
    movers = running_totals(movers, ["goal"], ["g", "shard"], {"before": F.col("n")}, tiles,
                            -F.floor(F.log2(F.col("size").cast("double"))))
    # shards not named here hold nothing that stays
    room = F.coalesce(*(F.when(F.col("goal") == s, F.lit(max(0, cap - n))) for s, n in stays.items()), F.lit(cap)) if stays else F.lit(cap)
    moved = F.greatest(F.lit(0), F.least(F.col("n"), room - F.col("before"))).cast("long")
    movers = movers.withColumn("moved", moved)
    parts = movers.select("g", F.explode(F.array(
        F.struct(F.col("goal").alias("shard"), F.col("moved").alias("n")),
        F.struct("shard", (F.col("n") - F.col("moved")).alias("n")))).alias("c")).select("g", "c.shard", "c.n")
    both = cells.where("goal = shard").select("g", "shard", "n").unionByName(parts)
    return stage(both.groupBy("g", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "cells")


def assign(docs: DataFrame, shards: int = SHARDS, rounds: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, g (the group), shard, slot for every row."""
    spark = docs.sparkSession
    text = F.col("text").cast("binary")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
                       F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
                       F.coalesce(F.md5(text), F.lit("")).alias("g"))
    rows = stage(rows, "rows")
    groups = stage(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "groups")
    n = groups.agg(F.sum("n")).first()[0] or 0
    tiles, cap = tiles_for(n), n // shards
    # no more of these than shards
    large = groups.where((F.col("n") > 1) & (F.col("n") >= cap)).orderBy(F.desc("n"), "g").collect() if cap else []
    whole, free = [], shards
    for r in large:
        taken = min(r.n // cap, free)
        whole += [(r.g, free - 1 - i, cap) for i in range(taken)]
        free -= taken
        if r.n > taken * cap:
            whole.append((r.g, r.n % max(free, 1), r.n - taken * cap))
    start = F.pmod(F.xxhash64("doc_id", "g"), F.lit(max(free, 1))).cast("int")
    rows = rows.withColumn("start", start)
    small = groups.where((F.col("n") > 1) & (F.col("n") < cap)).select("g") if cap else groups.where("n > 1").select("g")
    cells = rows.join(small, "g", "left_semi").groupBy("g", F.col("start").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    cells = stage(cells.unionByName(spark.createDataFrame(whole, "g string, shard int, n long")), "cells")
    seen = None
    for _ in range(ROUNDS if rounds is None else rounds):
        mark = cells.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("g", "shard", "n"))).first()
        if mark == seen:
            break
        seen, cells = mark, propagate(cells, cap, tiles)

    # linked rows take the places of their group's cells by rank
    spans = running_totals(cells, ["g"], ["shard"], {"low": F.col("n")}, 1)
    spans = spans.select("g", F.struct("low", (F.col("low") + F.col("n")).alias("high"), "shard").alias("span"))
    spans = spans.groupBy("g").agg(F.collect_list("span").alias("spans"))      # one per shard at most
    # both sides are plain tables, so that a hot group can be split
    rows = stage(rows.join(stage(spans, "spans"), "g", "left"), "placed")
    lone = rows.where("spans is null").select("doc_id", "size", "text_crc32", "g", F.col("start").alias("shard"), F.lit(1).alias("lone"))
    tied = running_totals(rows.where("spans is not null"), ["g"], ["doc_id", "start"], {"rank": F.lit(1)}, tiles)
    tied = tied.withColumn("shard", F.expr("filter(spans, x -> rank >= x.low and rank < x.high)[0].shard"))
    tied = tied.select("doc_id", "size", "text_crc32", "g", "shard", F.lit(0).alias("lone"))
    wanted = stage(tied.unionByName(lone), "wanted")

    # quotas: the first rows of a shard stay, the others fill what is free
    quota = [n // shards + (s < n % shards) for s in range(shards)]
    held = {r.shard: r.n for r in wanted.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    kept = [min(quota[s], held.get(s, 0)) for s in range(shards)]
    ranked = stage(running_totals(wanted, ["shard"], ["g", "doc_id"], {"slot": F.lit(1)}, tiles, F.col("lone")), "ranked")
    fits = F.col("slot") < F.element_at(F.array(*map(F.lit, quota)), F.col("shard") + 1)
    out = ["doc_id", "size", "text_crc32", "g", "shard", "slot"]
    pool = running_totals(ranked.where(~fits).drop("slot").withColumn("k", F.lit(0)), ["k"], ["g", "doc_id", "shard"], {"at": F.lit(1)}, tiles)
    ends, total = [], 0
    for s in range(shards):
        low, total = total, total + quota[s] - kept[s]
        ends.append((s, low, total))
    cases_shard = F.coalesce(*(F.when((F.col("at") >= a) & (F.col("at") < b), F.lit(s)) for s, a, b in ends))
    cases_slot = F.coalesce(*(F.when((F.col("at") >= a) & (F.col("at") < b), F.col("at") - a + kept[s]) for s, a, b in ends))
    moved = pool.withColumn("shard", cases_shard).withColumn("slot", cases_slot)
    return ranked.where(fits).select(out).unionByName(moved.select(out))


def report(docs: DataFrame) -> DataFrame:
    return assign(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
                               F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

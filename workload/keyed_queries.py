"""Changes of tables kept in place: the same results as the functions that return whole new tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidebars.operators import tables
from tidebars.operators.keyed import KeyedTable
from tidebars.session import stage_path
from workload import setup_queries as s
from workload import tables as t
from workload.registry import CHECKS, num, query, when

PARTS = 16


def kept(spark, rows, key):
    return KeyedTable.create(rows, stage_path(spark, "keyed"), key, PARTS)


@query("upsert_moves_in_place", CHECKS["upsert_moves"])
def upsert_moves_in_place(spark, sf_dir):
    """The updates are sent twice: the second time changes nothing."""
    table = kept(spark, t.moves(spark, sf_dir).select("symbol", "year", "gain_pct", "low_date"), ["symbol", "year"])
    for _ in range(2):
        table.change(s.updates(spark, sf_dir), tables.upsert_moves)
    return table.read().select("symbol", "year", num("gain_pct"), when("low_date"))


@query("remove_moves_in_place", CHECKS["remove_moves"])
def remove_moves_in_place(spark, sf_dir):
    moves = t.moves(spark, sf_dir)
    table = kept(spark, moves.select("symbol", "year", "gain_pct"), ["symbol", "year"])
    table.change(moves.filter(F.col("gain_pct") >= 40).select("symbol", "year"), tables.remove_moves)
    return table.read().select("symbol", "year", num("gain_pct"))


@query("apply_overrides_in_place", CHECKS["apply_overrides"])
def apply_overrides_in_place(spark, sf_dir):
    """Records with room for a person's columns; the corrections arrive in the order of their time, in two changes."""
    done = s.classified(spark, sf_dir).select(*s.CLASSIFIED_COLUMNS)
    empty = {"user_primary": "string", "user_secondary": "string", "user_note": "string", "user_reviewed": "boolean", "user_reviewed_at": "date"}
    table = kept(spark, done.withColumns({c: F.lit(None).cast(kind) for c, kind in empty.items()}), ["move_key"])
    sent = s.overrides(spark, sf_dir)
    first = F.col("saved_at") < F.to_timestamp(F.lit("2024-02-02 00:00:00"))
    for part in (sent.filter(first), sent.filter(~first)):
        table.change(part, tables.apply_overrides)
    return table.read().select("move_key", "ai_primary", "user_primary", "user_note", "user_reviewed",
                               F.col("user_reviewed_at").cast("string").alias("user_reviewed_at"))

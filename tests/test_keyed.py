"""Tables kept in place: what a change rewrites, and what happens when it dies."""
from pathlib import Path

import pytest

from tests.conftest import rows
from tidebars.operators import tables
from tidebars.operators.keyed import KeyedTable
from tidebars.session import stage_path

SCHEMA = "symbol string, year int, gain_pct double, note string"


def moves(spark, n, start=0):
    return spark.createDataFrame([(f"S{i % 50}", 2000 + i // 50, float(i), "old") for i in range(start, start + n)], SCHEMA)


@pytest.fixture
def table(spark):
    return KeyedTable.create(moves(spark, 400), stage_path(spark, "keyed"), ["symbol", "year"], 16)


def files(table):
    return {p.relative_to(table.path).as_posix(): p.stat().st_mtime_ns for p in Path(table.path, "rows").rglob("*.parquet")}


def updates(spark):
    return spark.createDataFrame([("S1", 2000, 1000.0), ("S2", 2003, 1001.0), ("NEW", 1990, 5.0)], "symbol string, year int, gain_pct double")


def test_a_change_rewrites_its_parts_only(spark, table):
    before = files(table)
    table.change(updates(spark), tables.upsert_moves)
    after = files(table)
    touched = {p.split("/")[1] for p in set(before) ^ set(after)}
    assert 1 <= len(touched) <= 3 and len({p.split("/")[1] for p in after}) == 16
    want = tables.upsert_moves(moves(spark, 400), updates(spark))
    assert rows(table.read(), "symbol", "year") == rows(want, "symbol", "year")


def test_again_is_the_same(spark, table):
    table.change(updates(spark), tables.upsert_moves)
    once = rows(table.read(), "symbol", "year")
    KeyedTable(spark, table.path).change(updates(spark), tables.upsert_moves)
    assert rows(table.read(), "symbol", "year") == once and len(once) == 401


def test_a_part_can_lose_all_its_rows(spark, table):
    table.change(moves(spark, 400).select("symbol", "year"), tables.remove_moves)
    assert table.read().count() == 0
    table.change(updates(spark).selectExpr("symbol", "year", "gain_pct", "'x' AS note"), tables.upsert_moves)
    assert table.read().count() == 3
    table.change(updates(spark).limit(0).selectExpr("symbol", "year", "gain_pct", "'x' AS note"), tables.upsert_moves)
    assert table.read().count() == 3


@pytest.mark.parametrize("dies", ["_replace", "_note", "half"])
def test_a_change_that_dies(spark, table, monkeypatch, dies):
    want = rows(tables.upsert_moves(moves(spark, 400), updates(spark)), "symbol", "year")
    before = rows(table.read(), "symbol", "year")

    def die(*args, **kwargs):
        raise RuntimeError("lost")

    def half(folder):
        """The old parts are gone, the new ones not there yet."""
        for part in Path(folder).glob("part=*"):
            for file in Path(table.path, "rows", part.name).glob("*"):
                file.unlink()
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(table, "_replace" if dies == "half" else dies, half if dies == "half" else die)
        with pytest.raises(RuntimeError):
            table.change(updates(spark), tables.upsert_moves)
    # before the note nothing has happened; after it the change is finished by whoever comes next
    assert rows(KeyedTable(spark, table.path).read(), "symbol", "year") == (before if dies == "_note" else want)
    table.change(updates(spark), tables.upsert_moves)
    assert rows(table.read(), "symbol", "year") == want

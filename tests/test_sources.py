"""Readers and cleaners on dirty files."""
import datetime as dt
import json

from pyspark.sql import functions as F

from tests.conftest import rows
from tests.makers import flat, frame
from tidebars.functions import parsing
from tidebars.operators import analytics
from tidebars.sources import bars as sb
from tidebars.sources import documents as docs
from tidebars.sources import moves as sm
from tidebars.sources import sinks
from tidebars.sources.benchmark import read_benchmark


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, raw string")


def test_dates(spark):
    df = texts(spark, "2020-01-02", " 01/31/2020 ", "13/45/2020", "", None, "junk", "2020-01-02 10:00:00", "1/2/2020", "2020-02-30")
    raw = F.col("raw")
    got = rows(df.select("i", parsing.iso_text(raw).alias("iso"), parsing.iso_or_same(raw).alias("same"),
                         parsing.padded_date(raw).alias("pad")), "i")
    assert [r["iso"] for r in got] == ["2020-01-02", "2020-01-31", None, None, None, None, "2020-01-02", None, None]
    assert [r["same"] for r in got] == ["2020-01-02", "2020-01-31", "13/45/2020", "", "", "junk", "2020-01-02", "1/2/2020", "2020-02-30"]
    assert got[7]["pad"] == "2020-01-02" and got[2]["pad"] is None


def test_numbers(spark):
    df = texts(spark, "1,234.5", "", "x", None, "nan", " 7 ")
    assert [r["v"] for r in rows(df.select("i", parsing.number(F.col("raw")).alias("v")), "i")] == [1234.5, None, None, None, None, 7.0]
    df = texts(spark, "52.00M", "1.23B", "450k", "1,000", "nan", "", "x", None, "M")
    got = [r["v"] for r in rows(df.select("i", parsing.volume(F.col("raw")).alias("v")), "i")]
    assert got == [52e6, 1.23e9, 450e3, 1000.0, 0.0, 0.0, 0.0, 0.0, 0.0]


def directory(tmp_path):
    (tmp_path / "AA.csv").write_text(
        ",DateTime,Open,High,Low,Close,Volume\n0,2020-01-03,1,2,0.5,1.5,10\n1,2020-01-02,1,2,0.5,1.4,\n2,2020-01-03,1,2,0.5,1.6,12\n")
    (tmp_path / "BB.csv").write_text(
        "DateTime,Open,High,Low,Close,Volume\n01/06/2020,5,6,4,5.5,20\n2020-01-07,5,6,4\n2020-01-08,5,6,4,x,20\n2020-01-09,5,6,4,0,20\n")
    (tmp_path / "cc.csv").write_text("date,close,open,high,low,volume\n2020-01-06,9,8,10,7,30\n")
    (tmp_path / "DD.csv").write_text(
        "Unnamed: 0,DateTime,Open,High,Low,Close,Volume\n0.0,2020-01-06,35.06,44,34.99,36,369\n")
    (tmp_path / "dd.csv").write_text("DateTime,Open,High,Low,Close,Volume\n2020-01-06,1,1,1,1,1\n")
    return str(tmp_path)


def day(d):
    return dt.datetime(2020, 1, d)


def test_core_rules(spark, tmp_path):
    got = rows(sb.read_bars(spark, directory(tmp_path)), "symbol", "ts")
    assert [(r["symbol"], r["ts"], r["close"], r["volume"]) for r in got] == [
        ("AA", day(2), 1.4, None), ("AA", day(3), 1.6, 12.0), ("BB", day(6), 5.5, 20.0), ("BB", day(7), None, None),
        ("BB", day(8), None, 20.0), ("BB", day(9), 0.0, 20.0), ("CC", day(6), 9.0, 30.0), ("DD", day(6), 36.0, 369.0)]
    assert got[6]["open"] == 8.0


def test_tolerant_rules(spark, tmp_path):
    got = rows(sb.read_bars(spark, directory(tmp_path), sb.TOLERANT), "symbol", "ts", "close")
    assert [(r["symbol"], r["ts"], r["close"]) for r in got] == [
        ("AA", day(3), 1.5), ("AA", day(3), 1.6), ("BB", day(6), 5.5), ("CC", day(6), 9.0), ("DD", day(6), 36.0)]
    assert got[3]["low"] == 7.0 and got[3]["volume"] == 30.0


def test_repair_rules(spark, tmp_path):
    got = rows(sb.read_bars(spark, directory(tmp_path), sb.REPAIR).filter("symbol IN ('AA', 'BB')"), "symbol", "ts", "close")
    assert [(r["symbol"], r["close"], r["volume"]) for r in got] == [
        ("AA", 1.4, 0.0), ("AA", 1.5, 10.0), ("AA", 1.6, 12.0), ("BB", 5.5, 20.0), ("BB", 0.0, 20.0)]


def test_audit(spark, tmp_path):
    got = {r["symbol"]: r for r in rows(sb.date_audit(spark, directory(tmp_path)), "symbol")}
    assert got["BB"]["needs_fix"] and got["BB"]["slashed"] == 1 and got["BB"]["date_col"] == 0
    assert not got["AA"]["needs_fix"] and got["AA"]["date_col"] == 1


def test_benchmark(spark, tmp_path):
    path = tmp_path / "bench.csv"
    path.write_text('﻿"Date","Price","Open","High","Low","Vol."\n"01/03/2020","3,234.50","3,226.36","3,246.15","3,222.34","52.00M"\n'
                    '"01/02/2020","3,257","3,244","3,258","3,235",""\n"01/06/2020","0","1","1","1","1K"\n"","1","1","1","1","1"\n')
    got = rows(read_benchmark(spark, str(path)), "ts")
    assert [(r["ts"], r["close"], r["volume"]) for r in got] == [(day(2), 3257.0, 0.0), (day(3), 3234.5, 52e6)]
    path.write_text("DateTime,Open,High,Low,Close,Volume\n2020-01-02,1,2,1,1.5,100\n2020-01-02,1,2,1,1.6,100\n")
    assert [r["close"] for r in rows(read_benchmark(spark, str(path), tolerant=False), "ts")] == [1.6]


def test_moves(spark, tmp_path):
    path = tmp_path / "moves.csv"
    path.write_text("﻿year,symbol,gain_pct,low_date,high_date,low_price,high_price,avg_vol_b,note\n"
                    "2020,AA,\"1,200.5\",2020-01-02,01/31/2020,1,2,0.1,x\n2021,BB,bad,,2021-02-01,1,2,0.1,\n")
    moves = sm.read_moves(spark, str(path))
    got = rows(moves, "year")
    assert got[0]["gain_pct"] == 1200.5 and got[0]["high_date"] == dt.date(2020, 1, 31) and got[0]["note"] == "x"
    assert got[1]["gain_pct"] is None and got[1]["low_date"] is None
    assert [r["symbol"] for r in rows(sm.filter_moves(moves, year=2021), "year")] == ["BB"]
    assert sm.filter_moves(moves, symbols=["AA"]).count() == 1
    assert sm.filter_moves(moves, symbols=moves.filter("year = 2021")).first().symbol == "BB"
    keyed = sm.split_key(sm.with_key(moves).drop("symbol", "year"))
    assert [(r["symbol"], r["year"]) for r in rows(keyed, "year")] == [("AA", 2020), ("BB", 2021)]
    bars = frame(spark, flat("aa", [1.0]))
    assert [r["has_bars"] for r in rows(sb.with_bars_flag(moves, bars), "year")] == [True, False]
    assert [r["symbol"] for r in rows(sb.missing_symbols(moves, bars.withColumn("symbol", F.upper("symbol"))), "symbol")] == ["BB"]


def test_annotations(spark, tmp_path):
    path = tmp_path / "notes.json"
    path.write_text(json.dumps({"customTags": ["Mine"], "version": 1, "items": {
        "AA_2020": {"direction": "long", "notes": "two\nlines", "rating": "B", "tags": ["EP", "VCP"]},
        "BB_2021": {"direction": "", "notes": "", "rating": "", "tags": []}}}, indent=1))
    notes = docs.read_annotations(spark, str(path))
    assert [(r["move_key"], r["tag"]) for r in rows(docs.explode_tags(notes), "move_key", "tag")] == [
        ("AA_2020", "EP"), ("AA_2020", "VCP"), ("BB_2021", None)]
    assert rows(notes, "move_key")[0]["notes"] == "two\nlines"
    assert [r["tag"] for r in rows(docs.read_custom_tags(spark, str(path)), "tag")] == ["Mine"]
    counts = {r["tag"]: r["n"] for r in rows(analytics.tag_counts(notes), "tag")}
    assert counts == {"EP": 1, "VCP": 1}
    assert rows(analytics.rename_tag(notes, "EP", "VCP"), "move_key")[0]["tags"] == ["VCP"]
    assert rows(analytics.delete_tag(notes, "EP"), "move_key")[0]["tags"] == ["VCP"]


def test_reviews(spark, tmp_path):
    path = tmp_path / "reviews.json"
    leg = {"of": 3, "period": "a to b", "setup": "VCP", "entry": None, "stop": None, "rationale": "x"}
    path.write_text(json.dumps({"AA_2020": {"reviewed_at": "2026-01-01", "gain_pct": 418.75, "snapshot": {"sma50_touches": 8}, "legs": [
        {"leg": 1, "pct_gain": "~40%", "tradable": True, **leg}, {"leg": 2, "pct_gain": "-12.5%", "tradable": False, **leg},
        {"leg": 3, "pct_gain": "n/a", "tradable": "Partially - thin", **leg}]}}))
    reviews = docs.read_reviews(spark, str(path))
    legs = analytics.legs_of(docs.review_of(reviews, "AA_2020"))
    assert [(r["leg"], r["gain_pct"], r["tradable"]) for r in rows(legs, "leg")] == [(1, 40.0, "yes"), (2, -12.5, "no"), (3, None, "partial")]
    total = analytics.leg_rollup(legs).first()
    assert (total.legs, total.tradable_legs, total.best_gain_pct, total.sum_gain_pct) == (3, 1, 40.0, 27.5)
    assert docs.review_of(reviews, "BB_2020").count() == 0


def test_bars_round_trip(spark, tmp_path):
    out = str(tmp_path / "out")
    bars = frame(spark, flat("A B", [10, 11, 12]))
    sinks.write_bars(bars, out)
    back = sb.read_bars(spark, out, symbol_pattern=sinks.FOLDER_SYMBOL)
    assert rows(back, "ts") == rows(bars, "ts")

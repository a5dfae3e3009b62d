"""Feeds by event time: what counts, what is dropped, and how much state is held."""
import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tests.makers import BAR_SCHEMA, frame, walk
from tidebars.operators import indicators
from tidebars.series import index_series
from tidebars.session import stage_path
from tidebars.streaming import event_time, extend, live

DAY = dt.datetime(2024, 1, 1)


def bar(symbol, day, close, volume=1.0):
    return symbol, DAY + dt.timedelta(days=day), close, close, close, close, volume


def feed_of(spark, arrivals):
    path = stage_path(spark, "test_feed")
    for rows in arrivals:
        rows = rows if not isinstance(rows, list) else spark.createDataFrame(rows, BAR_SCHEMA)
        rows.coalesce(1).write.mode("append").parquet(path)
    return extend.read_feed(spark, path, 1)


def drain(spark, bars):
    path = stage_path(spark, "test_table")
    query = event_time.write_periods(bars, path, stage_path(spark, "test_checkpoint"), once=True)
    query.awaitTermination()
    found = event_time.read_periods(spark, path)
    return {(r.symbol, (r.ts - DAY).days): r.close for r in found.collect()}, query


def test_first_arrivals(spark):
    arrivals = [
        [bar("A", 0, 1.0), bar("A", 1, 2.0), bar("B", 0, 5.0), bar("A", 2, -1.0), (None, DAY, 1.0, 1.0, 1.0, 1.0, 1.0)],
        [bar("A", 1, 9.0), bar("A", 2, 3.0), bar("A", 30, 4.0)],     # a repeat, a valid bar after an invalid one
        [bar("A", 60, 6.0), bar("B", 58, 7.0)],
        [bar("C", 3, 8.0), bar("B", 58, 9.0), bar("A", 61, 6.5)],     # far behind the watermark; a repeat within the delay
        [bar("A", 62, 1.0)],
    ]
    got, query = drain(spark, event_time.first_arrivals(feed_of(spark, arrivals), "5 days"))
    assert got == {("A", 0): 1.0, ("A", 1): 2.0, ("B", 0): 5.0, ("A", 2): 3.0, ("A", 30): 4.0, ("A", 60): 6.0, ("B", 58): 7.0, ("A", 61): 6.5, ("A", 62): 1.0}
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert held[-1] <= 4      # the bars of the last days
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in query.recentProgress if p["stateOperators"]) == 1


def test_settled(spark):
    arrivals = [
        [bar("A", 0, 1.0), bar("A", 1, 2.0)],
        [bar("A", 1, 2.5), bar("A", 4, 3.0)],     # a correction
        [bar("A", 1, -1.0), bar("A", 40, 4.0)],     # an invalid version hides nothing
        [bar("A", 90, 5.0)],
        [bar("A", 1, 99.0), bar("A", 91, 5.0)],     # too late
        [bar("A", 92, 5.0)],
    ]
    got, query = drain(spark, event_time.settled(feed_of(spark, arrivals), "5 days"))
    assert got == {("A", 0): 1.0, ("A", 1): 2.5, ("A", 4): 3.0, ("A", 40): 4.0}


def test_a_batch_that_runs_again_adds_nothing(spark):
    feed = stage_path(spark, "test_feed")
    spark.createDataFrame([bar("A", 0, 1.0)], BAR_SCHEMA).write.mode("append").parquet(feed)
    path, checkpoint = stage_path(spark, "test_table"), stage_path(spark, "test_checkpoint")
    for day in (1, 2):
        for _ in range(2):
            event_time.write_periods(event_time.first_arrivals(extend.read_feed(spark, feed, 1), "5 days"), path, checkpoint, once=True).awaitTermination()
        spark.createDataFrame([bar("A", 0, 7.0), bar("A", day, 2.0)], BAR_SCHEMA).write.mode("append").parquet(feed)
    event_time.write_periods(event_time.first_arrivals(extend.read_feed(spark, feed, 1), "5 days"), path, checkpoint, once=True).awaitTermination()
    found = event_time.read_periods(spark, path)
    assert sorted((r.close, r.period.day) for r in found.collect()) == [(1.0, 1), (2.0, 2), (2.0, 3)]


def plain_indicators(spark, pdf):
    wide = indicators.all_indicators(index_series(frame(spark, pdf)))
    return wide.select("symbol", "ts", "rn", "close", *live.INDICATORS).orderBy("symbol", "rn").toPandas()


def test_advance_equals_the_whole_series_after_any_split(spark):
    pdf = walk("A", 700, 5)
    want = plain_indicators(spark, pdf)
    rng = np.random.default_rng(1)
    for cuts in ([], [1], [1, 2, 3], sorted(rng.choice(700, 60, replace=False).tolist()), list(range(1, 700))):
        carry, got = live.START, []
        for a, b in zip([0, *cuts], [*cuts, 700]):
            if a == b:
                continue
            part = pdf.iloc[a:b]
            us = part.ts.astype("datetime64[us]").astype("int64").to_numpy()
            carry, out = live.advance(carry, us, *(part[c].to_numpy() for c in ("high", "low", "close", "volume")))
            got.append(pd.DataFrame(out))
        got = pd.concat(got, ignore_index=True)
        pd.testing.assert_frame_equal(got[["rn", *live.INDICATORS]], want[["rn", *live.INDICATORS]], check_dtype=False)
        assert (len(carry.closes), len(carry.volumes), len(carry.true_range)) == (199, 49, 19)


@pytest.mark.parametrize("seed", [1, 2])
def test_live_indicators(spark, seed):
    """Out of order, repeated and corrected bars over several batches give the indicators of the right bars."""
    live.use_state_store(spark)
    pdf = pd.concat([walk("A", 260, seed), walk("B", 120, seed + 10), walk("C", 3, seed + 20)])
    rng = np.random.default_rng(seed)
    day = (pdf.ts - pdf.ts.min()).dt.days
    # a bar comes up to eight days late; some come wrong first
    batch = ((day + rng.integers(0, 9, len(pdf))) // 60).to_numpy()
    wrong = rng.random(len(pdf)) < 0.2
    arrivals = []
    for k in range(batch.max() + 1):
        own = pdf[batch == k]
        first = own.assign(close=np.where(wrong[batch == k], own.close * 1.01, own.close))
        arrivals.append(frame(spark, pd.concat([first, pdf[(batch == k - 1) & wrong & (day // 60 == k - 1) & (day % 60 > 40)]])))
    rows = live.live_indicators(feed_of(spark, arrivals), "25 days")
    path = stage_path(spark, "test_live")
    rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", stage_path(spark, "test_live_checkpoint")).trigger(
        availableNow=True).start().awaitTermination()
    got = spark.read.schema(rows.schema).parquet(path).orderBy("symbol", "rn").toPandas()
    corrected = wrong & (day % 60 > 40).to_numpy() & (batch == (day // 60).to_numpy()) & (batch < batch.max())
    right = pdf.assign(close=np.where(wrong & ~corrected, pdf.close * 1.01, pdf.close))
    want = plain_indicators(spark, right)
    want = want[want.ts <= pdf.ts.max() - pd.Timedelta(days=25)].reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False)


def days(spark, path):
    return sorted((r.symbol, (r.ts - DAY).days, r.close) for r in extend.read_table(spark, path).collect())


def send(spark, path, batch, rows, feed="f"):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], BAR_SCHEMA + ", seq int")
    extend.add_batch(df, batch, path, feed)


def test_compaction(spark):
    path = stage_path(spark, "table")
    extend.start_table(spark.createDataFrame([bar("A", d, 1.0 + d) for d in range(0, 120, 10)], BAR_SCHEMA), path)
    assert extend.compact(spark, path) == 1 and extend.compact(spark, path) == 1     # nothing new
    for k in range(6):
        send(spark, path, k, [bar("A", 100 + k, 5.0), bar("A", 10 * k, 99.0), bar("B", 3, 7.0 + k)])
    want = days(spark, path)
    assert len(want) == 12 + 6 + 1 - 1 and ("B", 3, 7.0) in want and ("A", 10, 11.0) in want     # day 100 was there
    assert extend.compact(spark, path) == 2
    assert days(spark, path) == want
    # only months that batches touched have a new version
    _, months, _ = extend.manifest(spark, path)
    assert {m.isoformat(): v for m, v in months.items()} == {"2024-01-01": 2, "2024-02-01": 1, "2024-03-01": 1, "2024-04-01": 2}
    # a batch that runs again after it was gathered, and later ones
    send(spark, path, 5, [bar("A", 105, 6.0), bar("C", 1, 1.0)])
    assert days(spark, path) == want
    send(spark, path, 6, [bar("A", 105, 6.0), bar("C", 1, 1.0)])
    want = sorted([*want, ("C", 1, 1.0)])
    assert days(spark, path) == want
    extend.compact(spark, path)
    extend.clean(spark, path)
    assert days(spark, path) == want
    from pathlib import Path
    assert len(list(Path(path).rglob("month=*/*.parquet"))) == 4      # a file a month, whatever came
    send(spark, path, 7, [bar("A", 0, 2.0), bar("D", 1, 1.0)])
    assert days(spark, path) == sorted([*want, ("D", 1, 1.0)])


def test_a_compaction_that_dies_changes_nothing(spark, monkeypatch):
    path = stage_path(spark, "table")
    extend.start_table(spark.createDataFrame([bar("A", d, 1.0) for d in range(3)], BAR_SCHEMA), path)
    send(spark, path, 0, [bar("B", 1, 2.0)])
    want = days(spark, path)
    write = extend._write_months

    def half(bars, to, mode):
        write(bars.limit(1), to, mode)
        raise RuntimeError("lost")

    monkeypatch.setattr(extend, "_write_months", half)
    with pytest.raises(RuntimeError):
        extend.compact(spark, path)
    monkeypatch.undo()
    assert days(spark, path) == want
    extend.compact(spark, path)
    extend.clean(spark, path)
    assert days(spark, path) == want


def test_a_batch_reads_its_months_only(spark):
    path = stage_path(spark, "table")
    extend.start_table(spark.createDataFrame([bar("A", d, 1.0) for d in range(0, 700, 5)], BAR_SCHEMA), path)
    extend.compact(spark, path)
    read = extend.read_table(spark, path).filter("month in (date'2024-02-01')")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [") == 2 and all("month" in part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:])
    assert read.count() == 5

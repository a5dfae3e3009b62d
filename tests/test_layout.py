"""Bars laid out by chunk: no exchange, the same results."""
import pandas as pd
import pytest

from tests.makers import frame, walk
from tidebars.operators import indicators, swings
from tidebars.series import index_series
from tidebars.session import stage_path
from tidebars.sources import layout


@pytest.fixture(scope="module")
def table(spark):
    pdf = pd.concat([walk("A", 1500, 1), walk("B", 200, 2), walk("C", 5, 3)])
    indexed = index_series(frame(spark, pdf), chunk_rows=300).cache()
    path = stage_path(spark, "laid_out")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    layout.lay_out(indexed, name, path, buckets=4, after=10, chunk_rows=300)
    return indexed, name


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_indicators_without_an_exchange(spark, table):
    indexed, name = table
    got = indicators.all_indicators(layout.laid_out(spark, name, chunk_rows=300), chunk_rows=300)
    want = indicators.all_indicators(indexed, chunk_rows=300)
    assert "Exchange" in plan(want) and "Exchange" not in plan(got)
    columns = ["symbol", "rn", *indicators.PUBLIC_COLUMNS]
    a, b = (df.select(*columns).orderBy("symbol", "rn").toPandas() for df in (got, want))
    pd.testing.assert_frame_equal(a, b)


def test_windows_ahead_and_the_bars_themselves(spark, table):
    indexed, name = table
    got = swings.raw_swings(layout.laid_out(spark, name, after=3, chunk_rows=300), chunk_rows=300)
    want = swings.raw_swings(indexed, chunk_rows=300)
    assert "Exchange" not in plan(got)
    assert sorted(map(str, got.select("symbol", "rn", "kind").collect())) == sorted(map(str, want.select("symbol", "rn", "kind").collect()))
    assert layout.bars(spark, name).count() == 1705


def test_a_layout_for_less_is_refused(spark, table):
    _, name = table
    for asked in ({"before": 5000}, {"after": 11}, {"chunk_rows": 8192}):
        with pytest.raises(ValueError, match="laid out for"):
            layout.laid_out(spark, name, **{"chunk_rows": 300, **asked})

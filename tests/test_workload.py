"""The registered queries against their checking SQL, at the smallest scale."""
from pathlib import Path

import pytest

import __spark_entry__ as entry
import check
from workload.registry import CHECKS, QUERIES

DATA = Path("/root/testdata/sf0.001")


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)
    assert set(QUERIES) <= set(entry.queries()) and set(CHECKS) <= set(entry.oracle_sql())


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
def test_queries_match_their_checks(spark):
    assert check.main([str(DATA), *QUERIES]) == 0


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0

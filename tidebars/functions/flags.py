"""Conditions on bars as flags."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(condition: Column) -> Column:
    """A condition as true or false, never null."""
    return F.coalesce(condition, F.lit(False))

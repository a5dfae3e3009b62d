"""How a detector is written down: a list of criteria, a match rule and extras.

Conditions and values are SQL expressions over the columns of ``move_features``. A
criterion is met (true), failed (false) or not recorded (null). Only met criteria score.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

RESULT_TYPE = (
    "struct<setup:string,matched:boolean,score:int,"
    "criteria:array<struct<name:string,value:double,met:boolean>>,extra:map<string,string>>"
)


class Criterion(NamedTuple):
    name: str
    met: str
    points: int = 0
    value: str = "NULL"


def required(condition: str, when: str | None = None) -> str:
    """True or false; not recorded where ``when`` does not hold."""
    held = f"coalesce({condition}, false)"
    return held if when is None else f"CASE WHEN {when} THEN {held} END"


def bonus(condition: str, when: str | None = None) -> str:
    """True or not recorded: a miss is not a failure."""
    held = f"({condition})" if when is None else f"({condition}) AND ({when})"
    return f"CASE WHEN {held} THEN true END"


def failure(condition: str) -> str:
    """False where the condition holds, else not recorded."""
    return f"CASE WHEN {condition} THEN false END"


def result(setup: str, criteria: Sequence[Criterion], critical: str, extra: Mapping[str, str],
           min_score: int = 60) -> Column:
    """Struct of setup, matched, score, recorded criteria and extras."""
    points = " + ".join(f"CASE WHEN {c.met} THEN {c.points} ELSE 0 END" for c in criteria if c.points)
    score = f"least({points}, 100)"
    entries = ", ".join(
        f"named_struct('name', '{c.name}', 'value', CAST({c.value} AS DOUBLE), 'met', {c.met})" for c in criteria)
    pairs = ", ".join(f"'{k}', CAST({v} AS STRING)" for k, v in extra.items())
    return F.expr(
        f"CAST(named_struct('setup', '{setup}', 'matched', {score} >= {min_score} AND coalesce({critical}, false), "
        f"'score', {score}, 'criteria', filter(array({entries}), c -> c.met IS NOT NULL), 'extra', map({pairs})) "
        f"AS {RESULT_TYPE})"
    )


def failed_result(setup: str, message: str) -> Column:
    """What a detector that cannot be built contributes: no match, score 0."""
    return F.struct(
        F.lit(setup).alias("setup"), F.lit(False).alias("matched"), F.lit(0).alias("score"),
        F.array(F.struct(
            F.lit("detector_error").alias("name"), F.lit(None).cast("double").alias("value"), F.lit(False).alias("met"),
        )).alias("criteria"),
        F.create_map(F.lit("error"), F.lit(message)).alias("extra"),
    ).cast(RESULT_TYPE)

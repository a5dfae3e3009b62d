"""The detectors in tie order, and how to run them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.operators.setups import bases, days
from tidebars.operators.setups.rules import RESULT_TYPE, failed_result
from tidebars.series import MOVE_KEY

Detector = Callable[[], Column]

DETECTORS: dict[str, Detector] = {
    "VCP": bases.vcp,
    "Flat Base": bases.flat_base,
    "Cup with Handle": bases.cup_with_handle,
    "Double Bottom": bases.double_bottom,
    "HTF": bases.high_tight_flag,
    "Pocket Pivot": days.pocket_pivot,
    "Episodic Pivot": days.episodic_pivot,
    "Gap & Go": days.gap_and_go,
}


def register(name: str, detector: Detector, detectors: dict[str, Detector] | None = None) -> dict[str, Detector]:
    """A registry with one more detector, last in tie order; the given one is left as it is."""
    return {**(DETECTORS if detectors is None else detectors), name: detector}


def build(features: DataFrame, name: str, detector: Detector) -> Column:
    """The detector's result column, or a ``detector_error`` result if it cannot be resolved."""
    try:
        column = detector().cast(RESULT_TYPE)
        features.select(column).schema
        return column
    except Exception as error:
        return failed_result(name, str(error))


def detect(features: DataFrame, name: str, detectors: dict[str, Detector] | None = None) -> DataFrame:
    """One detector: key columns and ``result``."""
    table = DETECTORS if detectors is None else detectors
    return features.select(*MOVE_KEY, build(features, name, table[name]).alias("result"))


def detect_all(features: DataFrame, detectors: dict[str, Detector] | None = None) -> DataFrame:
    """All detectors: key columns and ``results``, an array in registry order."""
    table = DETECTORS if detectors is None else detectors
    columns = [build(features, name, d) for name, d in table.items()]
    return features.select(*MOVE_KEY, F.array(*columns).alias("results"))

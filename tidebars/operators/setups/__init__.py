"""Rule-based setup detectors: column arithmetic over ``move_features``."""
from tidebars.operators.setups.registry import DETECTORS, detect, detect_all, register

__all__ = ["DETECTORS", "detect", "detect_all", "register"]

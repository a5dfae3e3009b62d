"""A ratcheted band as a function of where it starts.

One step of an upper band: it stays where it is while the close before has not passed it and the new edge is not below it, else it
becomes the new edge. So a step keeps values between the close before and the edge, and sends all others to the edge. Steps
over many bars are a piecewise function of the entry value: on each piece a constant, or the entry value itself. Pieces soon run
together, so the function of thousands of bars is usually one constant. Beside its end value each piece has the number of the last
bar whose close was beyond the band, which tells the trend. A lower band is an upper band of negated numbers.

A chunk's function is computed without knowing where the chunk starts; walking over one function per chunk then gives all starts.
"""
from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterable, Sequence
from typing import NamedTuple

NEVER = -1
State = tuple[float, float, int]      # upper band, lower band, trend


class Pieces(NamedTuple):
    """Piece k is for entries from ``start[k]`` (the first from minus infinity) up to the next; a NaN ``value`` is the entry itself."""
    start: list[float]
    value: list[float]
    at: list[int]

    def end(self, entry: float) -> tuple[float, int]:
        k = bisect_right(self.start, entry) - 1
        return (entry if math.isnan(self.value[k]) else self.value[k]), self.at[k]


def follow(edges: Sequence[float], before: Sequence[float], closes: Sequence[float], numbers: Sequence[int]) -> Pieces:
    """The function of bars with these edges, closes before, closes and bar numbers, for an upper band; NaN closes before count as low."""
    pieces = [(-math.inf, math.nan, NEVER)]
    bars = list(zip(edges, before, closes, numbers))
    i = 0
    while i < len(bars) and (len(pieces) > 1 or math.isnan(pieces[0][1])):
        pieces = _step(pieces, *bars[i])
        i += 1
    if i < len(bars):     # one constant is left
        _, value, at = pieces[0]
        for edge, prev, close, number in bars[i:]:
            if value < prev or value > edge:
                value = edge
            if close > value:
                at = number
        pieces = [(-math.inf, value, at)]
    return Pieces(*map(list, zip(*pieces)))


def _step(pieces: list[tuple], edge: float, prev: float, close: float, number: int) -> list[tuple]:
    out: list[tuple] = []
    if math.isnan(close):
        close = -math.inf

    def put(start: float, value: float, at: int) -> None:
        if out and (out[-1][1] == value or (math.isnan(out[-1][1]) and math.isnan(value))) and out[-1][2] == at:
            return
        out.append((start, value, at))

    stop = [p[0] for p in pieces[1:]] + [math.inf]
    for (start, value, at), end in zip(pieces, stop):
        if not math.isnan(value):
            if value < prev or value > edge:
                value = edge
            put(start, value, number if close > value else at)
            continue
        reset = number if close > edge else at
        if prev >= edge:
            put(start, edge, reset)
            continue
        if start < prev:
            put(start, edge, reset)
            start = prev
        # entries below the close have their close beyond the band
        for a, b, event in ((start, min(edge, close), number), (max(start, close), edge, at)):
            if a < min(b, end):
                put(a, value, event)
        if edge < end:
            put(max(start, edge), edge, reset)
    return out


def first_state(upper: float, lower: float) -> State:
    return upper, lower, 1


def step(state: State, upper: float, lower: float, prev: float, close: float) -> State:
    """One bar, for both bands and the trend."""
    u, low, trend = state
    if u < prev or u > upper:
        u = upper
    if low > prev or low < lower:
        low = lower
    return u, low, 1 if close > u else -1 if close < low else trend


def end_state(state: State, upper: Pieces, lower: Pieces) -> State:
    """The state after bars with these functions; ``lower`` is in negated numbers."""
    u, up_at = upper.end(state[0])
    low, down_at = lower.end(-state[1])
    trend = state[2] if up_at == down_at == NEVER else 1 if up_at >= down_at else -1
    return u, -low, trend


def states(state: State | None, bars: Iterable[tuple[float, float, float, float]]) -> list[State]:
    """The state after each bar (upper edge, lower edge, close before, close); None starts at the first bar."""
    out = []
    for upper, lower, prev, close in bars:
        state = first_state(upper, lower) if state is None else step(state, upper, lower, prev, close)
        out.append(state)
    return out

"""Rolling and recursive columns over chunks with a halo.

A frame of n rows costs n updates per row in Spark, so long frames are put
together from short ones: a ten-row total, then one lag per ten rows.
"""
from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from tidebars.series import back, rows

BLOCK = 10
SHORT = 15   # spans up to this are one frame
MANY = 5     # spans of more blocks than this are built from a shorter span, if one divides them
NEGLIGIBLE_EXPONENT = 40.0   # exp(-40) is below double precision
LARGEST_EXPONENT = 600.0     # exp(600) is still a double


def total(src: str, n: int) -> str:
    """Sum of the last ``n`` values; null until ``n`` bars exist or if one of them is null.

    A null is summed as NaN, which the sum keeps: one running value instead of a sum and a count.
    """
    kept = f"sum(coalesce({src}, double('NaN'))) {rows(-(n - 1))}"
    return f"CASE WHEN rn >= {n} THEN nullif({kept}, double('NaN')) END"


def add(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add columns given as SQL expressions."""
    return df.selectExpr("*", *[f"{sql} AS {name}" for name, sql in columns.items()]) if columns else df


def apply(df: DataFrame, *plans: Sequence[Mapping[str, str]]) -> DataFrame:
    """Add the columns of several plans, phase by phase.

    A plan is a list of phases; the columns of a phase may use those of earlier ones. Phases of
    all plans are merged, so that Spark evaluates them in as few passes as possible. Helper
    columns, whose names start with an underscore, are dropped at the end.
    """
    helpers: list[str] = []
    for phase in itertools.zip_longest(*plans, fillvalue={}):
        columns = {name: sql for part in phase for name, sql in part.items()}
        helpers += [c for c in columns if c.startswith("_")]
        df = add(df, columns)
    return df.drop(*helpers)


def later(plan: Sequence[Mapping[str, str]], phases: int = 1) -> list[Mapping[str, str]]:
    """The same plan, some phases later: for inputs that are themselves computed."""
    return [{}] * phases + list(plan)


def rolling_means(specs: Mapping[str, tuple[str, int]]) -> list[dict[str, str]]:
    """Plan for ``out = mean of the last n values of src`` for each ``out: (src, n)``.

    A span is built from ten-row totals plus a remainder; a long one from the largest shorter
    span of the same source that divides it. Few columns per pass keep the generated code small.
    """
    phases: list[dict[str, str]] = [{}]
    built: dict[tuple[str, int], int] = {}     # (source, span) -> phase that has its total

    def put(phase: int, name: str, sql: str) -> None:
        while len(phases) <= phase:
            phases.append({})
        phases[phase][name] = sql

    for out, (src, n) in sorted(specs.items(), key=lambda item: item[1]):
        if n <= SHORT:
            put(0, out, f"({total(src, n)}) / {float(n)}D")
            continue
        put(0, f"_sum{BLOCK}_{src}", total(src, BLOCK))
        built.setdefault((src, BLOCK), 0)
        block = max(m for s, m in built if s == src and (m == BLOCK or (n > MANY * BLOCK and n % m == 0)))
        whole, rest = divmod(n, block)
        name, phase = f"_sum{block}_{src}", built[src, block] + 1
        parts = [name, *[back(name, block * j) for j in range(1, whole)]]
        if rest:
            tail = f"_sum{rest}_{src}"
            put(0, tail, total(src, rest))
            parts.append(back(tail, block * whole))
        put(phase, f"_sum{n}_{src}", " + ".join(parts))
        put(phase, out, f"({' + '.join(parts)}) / {float(n)}D")
        built[src, n] = phase
    needed = " ".join(sql for phase in phases for sql in phase.values())
    return [{k: v for k, v in phase.items() if not k.startswith("_") or k in needed} for phase in phases]


def rolling_extreme(out: str, src: str, widths: Sequence[int], largest: bool = True) -> list[dict[str, str]]:
    """Plan for the maximum (or minimum) of the last rows, as many as exist.

    ``widths`` are the spans of the steps, each a multiple of the one before; the last is the
    span of the result.
    """
    fn, pick = ("max", "greatest") if largest else ("min", "least")
    names = [f"_{fn}{n}_{src}" for n in widths[:-1]] + [out]
    plan = [{names[0]: f"{fn}({src}) {rows(-(widths[0] - 1))}"}]
    for small, wide, name, result in zip(widths, widths[1:], names, names[1:]):
        parts = [name, *[back(name, small * j) for j in range(1, wide // small)]]
        plan.append({result: f"{pick}({', '.join(parts)})"})
    return plan


def rate(span: int) -> float:
    """What a bar's weight loses with every later bar, as an exponent; a span of 1 forgets at once."""
    return -math.log(1 - 2.0 / (span + 1)) if span > 1 else math.inf


def ema_block(spans: Sequence[int]) -> int:
    """Block length of spans that share a pass: long enough for the slowest to forget."""
    return math.ceil(NEGLIGIBLE_EXPONENT / rate(max(spans)))


def ema_passes(spans: Sequence[int]) -> list[list[int]]:
    """Spans in groups whose blocks are short enough for the fastest not to overflow."""
    groups: list[list[int]] = []
    for n in sorted({n for n in spans if n > 1}, reverse=True):
        if groups and ema_block(groups[-1]) * rate(n) <= LARGEST_EXPONENT:
            groups[-1].append(n)
        else:
            groups.append([n])
    return groups


def ema_halo(spans: Sequence[int]) -> int:
    """Rows needed ahead of a chunk so that its first bar has its carry."""
    return max((2 * ema_block(group) for group in ema_passes(spans)), default=0)


def exponential_means(specs: Mapping[str, tuple[str, int]]) -> list[dict[str, str]]:
    """Plan for ``y = a*x + (1-a)*y_prev`` (``y = x`` on the first bar) for each ``out: (src, span)``.

    Closed form in blocks of rows: inside a block a weighted running sum, plus the
    final value of the block before; anything older is below double precision. Spans far apart get blocks of their own.
    Needs ``ema_halo`` rows of halo and no null inputs.
    """
    plans = [_means_of_pass({o: (s, n) for o, (s, n) in specs.items() if n in group}) for group in ema_passes([n for _, n in specs.values()])]
    plans.append([{o: src for o, (src, n) in specs.items() if n == 1}])
    return [{k: v for part in phase for k, v in part.items()} for phase in itertools.zip_longest(*plans, fillvalue={})]


def _means_of_pass(specs: Mapping[str, tuple[str, int]]) -> list[dict[str, str]]:
    length = ema_block([n for _, n in specs.values()])
    offset = f"pmod(rn - 1, {length})"
    inside = (f"OVER (PARTITION BY symbol, chunk, floor((rn - 1) / {length}) ORDER BY rn "
              "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    local: dict[str, str] = {}
    carry: dict[str, str] = {}
    result: dict[str, str] = {}
    for out, (src, n) in specs.items():
        alpha = 2.0 / (n + 1)
        keep = f"{1.0 - alpha!r}D"
        weight = f"CASE WHEN rn = 1 THEN 1D ELSE {alpha!r}D END"
        local[f"_loc_{out}"] = f"sum({weight} * {src} * pow({keep}, -{offset})) {inside} * pow({keep}, {offset})"
        carry[f"_car_{out}"] = (
            f"last(CASE WHEN {offset} = {length - 1} THEN _loc_{out} END, true) {rows('first', -1)}")
        result[out] = f"_loc_{out} + coalesce(_car_{out}, 0D) * pow({keep}, {offset} + 1)"
    return [local, carry, result]

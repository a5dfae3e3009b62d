"""One wide row of measurements per move, read by all setup detectors.

A move needs at most ``BACK`` bars before its base, the base, and ``AHEAD`` bars
after its pivot, so the rows of a move are bounded and its windows are small.
The bars after the pivot and the swings around it make every result retrospective.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.operators.indicators import POLE_LENGTHS
from tidebars.series import CHUNK, MOVE_KEY, span_bars

CUP_BACK = 200
BACK = CUP_BACK + 64
AHEAD = 5
GAP_BACK = 60
POST_GAP_BARS = 10
WAVE_BARS = 70
EP_GAP, EP_REL_VOL = 0.05, 2.5
GO_GAP, GO_REL_VOL = 0.10, 3.0


def attach_swings(frame: DataFrame, swing_table: DataFrame) -> DataFrame:
    """Bars with ``swing_kind`` and ``swing_price`` where a swing survived the collapse."""
    marks = swing_table.select(
        "symbol", "chunk", "rn", F.col("kind").alias("swing_kind"), F.col("price").alias("swing_price")
    )
    return frame.join(marks, ["symbol", "chunk", "rn"], "left")


def gap_events(frame: DataFrame, min_gap: float = EP_GAP, min_rel_vol: float = EP_REL_VOL) -> DataFrame:
    """Bars that open away from the previous close on volume; strength = gap times volume ratio."""
    hit = (F.col("gap_pct") >= min_gap) & (F.col("avg_vol_50") > 0) & (F.col("rel_vol") >= min_rel_vol)
    return frame.filter(hit).select(
        "symbol", "chunk", "rn", "ts", "open", "high", "low", "close", "prev_close", "gap_pct", "rel_vol",
        (F.col("gap_pct") * F.col("rel_vol")).alias("strength"),
    )


def context_bars(pivot_table: DataFrame, frame: DataFrame, chunk_rows: int = CHUNK) -> DataFrame:
    """The bars around each pivot that any detector looks at."""
    spans = pivot_table.select(
        *MOVE_KEY, "rn_pivot", "rn_base_start", "rn_base_end", "base_len", "base_high", "base_low",
        "base_depth_pct", "breakout_rel_vol",
        F.greatest(F.lit(1), F.col("rn_base_start") - BACK).alias("rn_first"),
        (F.col("rn_pivot") + AHEAD).alias("rn_last"),
    )
    return span_bars(spans, frame, "rn_first", "rn_last", chunk_rows)


# bars of a move's context that a measurement is taken over
IN_BASE = "rn BETWEEN rn_base_start AND rn_base_end"
IN_CUP = "rn BETWEEN rn_edge AND rn_base_start"
IN_WAVE = f"rn BETWEEN rn_pivot - {WAVE_BARS - 1} AND rn_pivot"
GAP_FROM = f"rn > greatest(1, rn_pivot - {GAP_BACK})"


def at(rn: str, column: str, name: str) -> str:
    """Value of a column on the bar with row number ``rn``."""
    return f"max(CASE WHEN rn = {rn} THEN {column} END) AS {name}"


def best_ep() -> str:
    """Strongest gap of the episodic-pivot window, earliest on ties."""
    return f"""max(CASE WHEN {GAP_FROM} AND rn <= rn_pivot + {AHEAD - 1} AND post_bars >= 1
        AND gap_pct >= {EP_GAP} AND avg_vol_50 > 0 AND rel_vol >= {EP_REL_VOL} THEN named_struct(
      'strength', gap_pct * rel_vol, 'o', -rn, 'ts', ts, 'gap_pct', gap_pct, 'rel_vol', rel_vol,
      'held', coalesce(post_low >= low * 0.98, false),
      'post_range', coalesce(CASE WHEN post_high > 0 THEN (post_high - post_low) / post_high END, 1D),
      'gap_fill', coalesce(CASE WHEN open > prev_close THEN (open - two_low) / (open - prev_close) END, 0D),
      'close_pos', coalesce(post_close_pos, 0D), 'post_bars', post_bars) END) AS ep"""


def best_go() -> str:
    """Strongest gap of the gap-and-go window; those that pass the gate come first."""
    above, unfilled = "coalesce(close > open, false)", "coalesce(low > prev_close, false)"
    return f"""max(CASE WHEN {GAP_FROM} AND rn <= rn_pivot
        AND gap_pct >= {GO_GAP} AND avg_vol_50 > 0 AND rel_vol >= {GO_REL_VOL} THEN named_struct(
      'gate', {above} AND {unfilled}, 'strength', gap_pct * rel_vol, 'o', -rn, 'ts', ts, 'gap_pct', gap_pct,
      'rel_vol', rel_vol, 'above_open', {above}, 'unfilled', {unfilled},
      'close_pos', coalesce(close_pos, 0.5D)) END) AS go"""


def swing_list(condition: str, name: str) -> str:
    """Swings of the context as an array in time order; bounded by the context length."""
    return f"""sort_array(collect_list(CASE WHEN {condition} AND swing_kind IS NOT NULL THEN named_struct(
      'rn', rn, 'kind', swing_kind, 'price', swing_price, 'ts', ts, 'close', close,
      'prior_start_close', prior_start_close) END)) AS {name}"""


PIVOT_BAR = ("close", "low", "volume", "prev_close", "close_pos", "high_252", "sma50", "sma200", "ema10",
             "sma50_back", "max_down_vol", "n_down_days")
MOVE_CONSTANTS = ("rn_pivot", "rn_base_start", "base_len", "base_high", "base_low", "base_depth_pct")


def move_features(pivot_table: DataFrame, frame: DataFrame, chunk_rows: int = CHUNK) -> DataFrame:
    """All measurements, one row per move with a pivot. ``frame`` carries indicators and swings.

    The windows and the aggregation share one exchange on the move.
    """
    whole = f"OVER (PARTITION BY {', '.join(MOVE_KEY)})"
    ahead = f"OVER (PARTITION BY {', '.join(MOVE_KEY)} ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND "
    after, two = f"{ahead} {POST_GAP_BARS} FOLLOWING)", f"{ahead} 2 FOLLOWING)"
    bars = context_bars(pivot_table, frame, chunk_rows).selectExpr(
        "*",
        f"count(1) {after} AS post_bars", f"max(high) {after} AS post_high", f"min(low) {after} AS post_low",
        f"min(low) {two} AS two_low", f"first(close_pos, true) {after} AS post_close_pos",
        f"max(CASE WHEN rn BETWEEN rn_base_start - {CUP_BACK} AND rn_base_start - 1 "
        f"AND high BETWEEN base_high * 0.98 AND base_high * 1.02 THEN rn END) {whole} AS rn_edge",
    ).selectExpr("*", f"min(CASE WHEN {IN_CUP} THEN low END) {whole} AS cup_low")
    measures = [
        *[f"first({c}) AS {c}" for c in (*MOVE_CONSTANTS, "rn_edge", "cup_low")],
        "first(breakout_rel_vol) AS rel_vol",
        # base
        *[at("rn_base_start", c, n) for c, n in (
            ("close", "start_close"), ("prior_start_close", "prior_start_close"), ("sma50", "start_sma50"))],
        at("rn_base_end", "sma50", "end_sma50"),
        f"avg(CASE WHEN {IN_BASE} THEN volume END) AS base_volume",
        "avg(CASE WHEN rn BETWEEN rn_base_end - 9 AND rn_base_end THEN volume END) AS last10_volume",
        f"regr_slope(CASE WHEN {IN_BASE} THEN close END, CAST(rn - rn_base_start AS DOUBLE)) AS close_slope",
        f"avg(CASE WHEN {IN_BASE} THEN close END) AS mean_close",
        # pole
        *[at("rn_base_start", c, c) for n in POLE_LENGTHS for c in (f"close_back_{n}", f"vol_before_{n}")],
        # pivot bar
        *[at("rn_pivot", c, f"p_{c}") for c in PIVOT_BAR],
        # cup
        f"max(CASE WHEN {IN_CUP} THEN high END) AS cup_high",
        f"count(CASE WHEN {IN_CUP} AND low <= cup_low * 1.05 THEN 1 END) AS cup_bottom_bars",
        *[at("rn_edge", c, n) for c, n in (
            ("close", "edge_close"), ("ts", "edge_date"), ("prior_start_close", "edge_prior_close"))],
        # swings and gaps
        swing_list(IN_BASE, "base_swings"), swing_list(IN_WAVE, "wave_swings"), best_ep(), best_go(),
    ]
    return derived(bars.groupBy(*MOVE_KEY).agg(*[F.expr(m) for m in measures]))


def since(anchor: str, close: str, start: str) -> str:
    """Gain of a close over the one up to 63 bars earlier; needs five bars of history."""
    return f"CASE WHEN {anchor} >= 6 AND {start} > 0 THEN {close} / {start} - 1D END"


def share(part: str, of: str) -> str:
    return f"CASE WHEN {of} > 0 THEN {part} / {of} END"


def derived(gathered: DataFrame) -> DataFrame:
    """Measurements that follow from the gathered ones."""
    drop = "(s.price - get(base_swings, i + 1).price) / s.price"
    poles = ", ".join(
        f"CASE WHEN rn_base_start > {n} AND close_back_{n} > 0 THEN named_struct('gain', start_close / close_back_{n} - 1D, "
        f"'o', -{n}, 'volume', vol_before_{n}) END" for n in POLE_LENGTHS)
    listed = gathered.selectExpr(
        "*",
        # depth of each drop from a swing high to the next swing of the base
        "filter(transform(base_swings, (s, i) -> CASE WHEN s.kind = 'high' AND i + 1 < size(base_swings) AND s.price > 0 "
        f"THEN {drop} END), d -> d > 0) AS contractions",
        "filter(wave_swings, s -> s.kind = 'low') AS wave_lows",
        f"array_max(filter(array({poles}), g -> g.gain > 0)) AS pole",
    ).selectExpr(
        "*",
        "size(contractions) AS n_contractions",
        "size(filter(transform(contractions, (d, i) -> i > 0 AND d > get(contractions, i - 1)), x -> x)) AS n_rises",
        "get(contractions, size(contractions) - 1) AS last_contraction",
        "CASE WHEN size(wave_lows) >= 2 THEN element_at(wave_lows, -2) END AS low1",
        "CASE WHEN size(wave_lows) >= 2 THEN element_at(wave_lows, -1) END AS low2",
    ).selectExpr(
        "*",
        "array_max(transform(filter(wave_swings, s -> s.kind = 'high' AND s.rn > low1.rn AND s.rn < low2.rn), "
        "s -> named_struct('price', s.price, 'o', -s.rn, 'ts', s.ts))) AS peak",
    )
    return listed.selectExpr(
        "*",
        since("rn_base_start", "start_close", "prior_start_close") + " AS prior_gain",
        since("rn_edge", "edge_close", "edge_prior_close") + " AS edge_prior_gain",
        since("low1.rn", "low1.close", "low1.prior_start_close") + " AS low1_prior_gain",
        "CASE WHEN low1.price > 0 THEN abs(low2.price - low1.price) / low1.price ELSE 1D END AS lows_apart",
        "CASE WHEN low1.price > 0 THEN (peak.price - low1.price) / low1.price ELSE 0D END AS rally",
        share("abs(close_slope)", "mean_close") + " AS slope_ratio",
        share("(p_high_252 - p_close)", "p_high_252") + " AS off_high",
        "rn_base_start - rn_edge + 1 AS cup_days",
        share("(cup_high - cup_low)", "cup_high") + " AS cup_depth",
        share("(base_high - base_low)", "base_high") + " AS handle_depth",
    ).drop("wave_lows")

"""Common table expressions for the checking SQL (DuckDB).

They state the same results another way: plain windows over a whole symbol,
recursion for exponential means, all pairs for best moves and bases. They are for
checking at small scale, not for speed.
"""
from __future__ import annotations

from collections.abc import Sequence

TS = "%Y-%m-%d %H:%M:%S"


def r(expression: str, places: int = 6) -> str:
    return f"(round({expression}, {places}) + 0.0)"


def at(expression: str) -> str:
    return f"strftime({expression}, '{TS}')"


def day(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d')"


def walk(name: str, sums: str, pace: str) -> str:
    """Bars from per-bar sums; the twin of ``tables.walk``."""
    price = lambda x: f"100.0 * exp({pace} * ({x}) / 5000.0)"
    before = "(level - (s - 5000 * n))"
    return f"""
{name}_level AS (
  SELECT *, sum(s - 5000 * n) OVER (PARTITION BY symbol ORDER BY ts) AS level FROM {sums}
), {name}_price AS (
  SELECT symbol, ts, s, {price(f"{before} + ((f % 7) - 1) / 5.0 * (f - 5000)")} AS o, {price("level")} AS c
  FROM {name}_level
), {name} AS MATERIALIZED (
  SELECT symbol, ts, round(o, 2) AS open,
    round(greatest(o, c) * exp({pace} * (s % 11) / 20.0), 2) AS high,
    round(least(o, c) * exp(-{pace} * (s % 13) / 24.0), 2) AS low,
    round(c, 2) AS close, s::DOUBLE AS volume,
    row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn
  FROM {name}_price
)"""


TICKS = """
ticks AS (
  SELECT event_type || '_' || (user_id % 4) AS symbol, ts AS seen, event_id AS id,
    round(value * 100)::BIGINT AS cents FROM events
), sums AS (
  SELECT symbol, date_trunc('minute', seen) AS ts, count(*) AS n, sum(cents)::BIGINT AS s,
    first(cents ORDER BY seen, id) AS f FROM ticks GROUP BY ALL
)"""

BARS = TICKS + "," + walk("bars", "sums", "0.02")

BENCH = """
bench_sums AS (
  SELECT 'ALL' AS symbol, date_trunc('hour', seen) AS ts, count(*) AS n, sum(cents)::BIGINT AS s,
    first(cents ORDER BY seen, id) AS f FROM ticks GROUP BY ALL
),""" + walk("bench", "bench_sums", "0.002")

DAILY = """
dsums AS (
  SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, count(*) AS n,
    sum(round(o_totalprice / 50)::BIGINT)::BIGINT AS s,
    first(round(o_totalprice / 50)::BIGINT ORDER BY o_orderdate, o_orderkey) AS f
  FROM orders GROUP BY ALL
),""" + walk("dbars", "dsums", "0.02")


def full(fn: str, value: str, n: int) -> str:
    frame = f"OVER (PARTITION BY symbol ORDER BY rn ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({value}) {frame} = {n} THEN {fn}({value}) {frame} END"


EMA = """
ema AS (
  SELECT symbol, rn, close AS ema10, close AS ema20 FROM bars WHERE rn = 1
  UNION ALL
  SELECT b.symbol, b.rn, 2 / 11::DOUBLE * b.close + 9 / 11::DOUBLE * e.ema10,
    2 / 21::DOUBLE * b.close + 19 / 21::DOUBLE * e.ema20
  FROM ema e JOIN bars b ON b.symbol = e.symbol AND b.rn = e.rn + 1
)"""

ASOF = """
aligned AS (
  SELECT b.*, x.close AS bench_close FROM bars b ASOF LEFT JOIN bench x ON b.ts >= x.ts
)"""

IND = f"""
stepped AS (
  SELECT *, lag(close) OVER w AS prev_close, (high - low) / close * 100 AS range_pct,
    greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS true_range
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY rn)
), ind AS MATERIALIZED (
  SELECT *, {full('avg', 'close', 50)} AS sma50, {full('avg', 'close', 150)} AS sma150,
    {full('avg', 'close', 200)} AS sma200, {full('avg', 'volume', 50)} AS avg_vol_50,
    volume / {full('avg', 'volume', 50)} AS rel_vol, {full('avg', 'range_pct', 20)} AS adr_pct_20,
    {full('avg', 'true_range', 20)} AS atr_20, {full('avg', 'volume', 20)} AS vol_mean_20,
    (open - prev_close) / prev_close AS gap_pct,
    CASE WHEN high > low THEN (close - low) / (high - low) END AS close_pos
  FROM stepped
)"""

SWINGS = """
sides AS (
  SELECT *, max(high) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS lh,
    max(high) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS rh,
    min(low) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS ll,
    min(low) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS rl,
    count(*) OVER (PARTITION BY symbol) AS total
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY rn)
), raw_swings AS (
  SELECT symbol, rn, ts, kind, CASE kind WHEN 'high' THEN high ELSE low END AS price
  FROM (SELECT *, CASE WHEN high > lh AND high > rh THEN 'high' WHEN low < ll AND low < rl THEN 'low' END AS kind
        FROM sides WHERE rn > 3 AND rn <= total - 3) WHERE kind IS NOT NULL
), islands AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY rn)
    - row_number() OVER (PARTITION BY symbol, kind ORDER BY rn) AS island FROM raw_swings
), ranked_swings AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, kind, island
    ORDER BY CASE kind WHEN 'high' THEN -price ELSE price END, rn) AS k,
    max(rn) OVER (PARTITION BY symbol, kind, island) AS last_rn FROM islands
), swings AS MATERIALIZED (
  SELECT symbol, rn, ts, kind, price, last_rn, coalesce(lag(last_rn) OVER (PARTITION BY symbol ORDER BY rn), 0) AS after_rn
  FROM ranked_swings WHERE k = 1
)"""

WEEK = "floor((epoch({0}) + 259200) / 604800)::INT"

MOVES = f"""
pairs AS (
  SELECT h.symbol, {WEEK.format('h.ts')} AS year, (h.close / l.close - 1) * 100 AS gain_pct,
    l.rn AS rn_lo, h.rn AS rn_hi, l.ts AS low_date, h.ts AS high_date, l.close AS low_price, h.close AS high_price
  FROM bars h JOIN bars l ON h.symbol = l.symbol AND {WEEK.format('h.ts')} = {WEEK.format('l.ts')} AND l.rn <= h.rn
), volumes AS (
  SELECT symbol, {WEEK.format('ts')} AS year, avg(volume) / 1e9 AS avg_vol_b FROM bars GROUP BY ALL
), moves AS MATERIALIZED (
  SELECT p.*, v.avg_vol_b, p.rn_hi - p.rn_lo + 1 AS n_bars FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol, year ORDER BY gain_pct DESC, rn_hi, low_price, rn_lo) AS k
    FROM pairs WHERE gain_pct > 0) p JOIN volumes v USING (symbol, year) WHERE k = 1
)"""

PAIRS = """
days AS (
  SELECT m.symbol, m.year, m.rn_lo, i.rn, i.rn - m.rn_lo AS pos, i.close, i.rel_vol
  FROM moves m JOIN ind i ON i.symbol = m.symbol AND i.rn BETWEEN m.rn_lo + 15 AND m.rn_hi - 1
  WHERE i.rel_vol >= 1.4 AND m.n_bars >= 17 AND m.low_date < m.high_date
), bases AS (
  SELECT d.symbol, d.year, d.rn, d.pos, d.close, d.rel_vol, g.len, max(b.high) AS base_high, min(b.low) AS base_low
  FROM days d JOIN (SELECT unnest(range(15, 81, 3)) AS len) g ON g.len <= d.pos
    JOIN bars b ON b.symbol = d.symbol AND b.rn BETWEEN d.rn - g.len AND d.rn - 1
  GROUP BY ALL
), scored AS (
  SELECT *, (base_high - base_low) / base_high AS depth,
    0.45::DOUBLE * (least(len, 50) / 50.0::DOUBLE)
    + 0.40::DOUBLE * greatest(0.0::DOUBLE, 1.0::DOUBLE - (base_high - base_low) / base_high / 0.25::DOUBLE)
    + 0.15::DOUBLE * least(rel_vol / 3.0::DOUBLE, 1.0::DOUBLE) AS quality
  FROM bases WHERE base_high > 0 AND (base_high - base_low) / base_high <= 0.25 AND close > base_high
)"""

PIVOTS = PAIRS + """, pivots AS MATERIALIZED (
  SELECT symbol, year, rn AS rn_pivot, pos, len AS base_len, rn - len AS rn_bs, rn - 1 AS rn_be,
    base_high, base_low, depth * 100 AS depth_pct, rel_vol, close, quality
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol, year ORDER BY quality DESC, pos, len) AS k FROM scored)
  WHERE k = 1
)"""


def bar(column: str, rn: str, table: str = "ind", alias: str = "p") -> str:
    return f"(SELECT b.{column} FROM {table} b WHERE b.symbol = {alias}.symbol AND b.rn = {rn})"


def prior(rn: str, close: str) -> str:
    start = bar("close", f"greatest(1, {rn} - 63)")
    return f"CASE WHEN {rn} >= 6 THEN {close} / {start} - 1 END"


def over(fn: str, lo: str, hi: str, where: str = "true", table: str = "ind") -> str:
    return (f"(SELECT {fn} FROM {table} b WHERE b.symbol = p.symbol AND b.rn BETWEEN {lo} AND {hi} AND {where})")


BASE = f"""
base AS MATERIALIZED (
  SELECT p.*, {bar('close', 'p.rn_bs')} AS start_close, {bar('sma50', 'p.rn_bs')} AS start_sma50,
    {bar('sma50', 'p.rn_be')} AS end_sma50,
    {prior('p.rn_bs', bar('close', 'p.rn_bs'))} AS prior_gain,
    {over('avg(b.volume)', 'p.rn_bs', 'p.rn_be')} AS base_volume,
    {over('avg(b.volume)', 'p.rn_be - 9', 'p.rn_be')} AS last10_volume,
    {over('abs(regr_slope(b.close, b.rn - p.rn_bs)) / avg(b.close)', 'p.rn_bs', 'p.rn_be')} AS slope_ratio,
    {bar('close_pos', 'p.rn_pivot')} AS close_pos,
    {over('max(b.high)', 'p.rn_pivot - 251', 'p.rn_pivot')} AS high_252
  FROM pivots p
)"""

CONTRACTIONS = """
base_swings AS (
  SELECT p.symbol, p.year, s.rn, s.kind, s.price,
    lead(s.price) OVER (PARTITION BY p.symbol, p.year ORDER BY s.rn) AS next_price
  FROM pivots p JOIN swings s ON s.symbol = p.symbol AND s.rn BETWEEN p.rn_bs AND p.rn_be
), drops AS (
  SELECT symbol, year, rn, (price - next_price) / price AS depth FROM base_swings
  WHERE kind = 'high' AND next_price IS NOT NULL AND price > next_price
), steps AS (
  SELECT *, lag(depth) OVER (PARTITION BY symbol, year ORDER BY rn) AS earlier FROM drops
), contr AS MATERIALIZED (
  SELECT p.symbol, p.year, count(d.rn) AS n_contr, count(CASE WHEN d.depth > d.earlier THEN 1 END) AS n_rises,
    arg_max(d.depth, d.rn) AS last_contr
  FROM pivots p LEFT JOIN steps d ON d.symbol = p.symbol AND d.year = p.year GROUP BY ALL
)"""

CUP = f"""
edges AS (
  SELECT p.*, {over('max(b.rn)', 'p.rn_bs - 200', 'p.rn_bs - 1',
                    'b.high BETWEEN p.base_high * 0.98 AND p.base_high * 1.02')} AS rn_edge FROM base p
), cup AS MATERIALIZED (
  SELECT p.*, {bar('ts', 'p.rn_edge')} AS edge_date, {prior('p.rn_edge', bar('close', 'p.rn_edge'))} AS edge_gain,
    p.rn_bs - p.rn_edge + 1 AS cup_days, {over('max(b.high)', 'p.rn_edge', 'p.rn_bs')} AS cup_high,
    {over('min(b.low)', 'p.rn_edge', 'p.rn_bs')} AS cup_low,
    {over('count(*)', 'p.rn_edge', 'p.rn_bs',
          'b.low <= 1.05 * (SELECT min(c.low) FROM ind c WHERE c.symbol = p.symbol AND c.rn BETWEEN p.rn_edge AND p.rn_bs)')}
      AS bottom_bars,
    (p.base_high - p.base_low) / p.base_high AS handle_depth
  FROM edges p
)"""

WAVE = f"""
wave_lows AS (
  SELECT p.symbol, p.year, s.rn, s.ts, s.price, row_number() OVER (PARTITION BY p.symbol, p.year ORDER BY s.rn DESC) AS k
  FROM pivots p JOIN swings s ON s.symbol = p.symbol AND s.kind = 'low' AND s.rn BETWEEN p.rn_pivot - 69 AND p.rn_pivot
), wave_pair AS (
  SELECT p.*, a.rn AS rn1, a.ts AS ts1, a.price AS price1, b.rn AS rn2, b.ts AS ts2, b.price AS price2
  FROM pivots p LEFT JOIN wave_lows a ON a.symbol = p.symbol AND a.year = p.year AND a.k = 2
    LEFT JOIN wave_lows b ON b.symbol = p.symbol AND b.year = p.year AND b.k = 2 - 1 AND a.rn IS NOT NULL
), wave AS MATERIALIZED (
  SELECT p.*, {prior('p.rn1', bar('close', 'p.rn1'))} AS gain1,
    (SELECT max(s.price) FROM swings s WHERE s.symbol = p.symbol AND s.kind = 'high' AND s.rn > p.rn1 AND s.rn < p.rn2) AS peak,
    abs(price2 - price1) / price1 AS apart
  FROM wave_pair p
)"""

POLE = f"""
poles AS (
  SELECT p.*, g.len, p.start_close / {bar('close', 'p.rn_bs - g.len')} - 1 AS gain,
    {over('avg(b.volume)', 'p.rn_bs - g.len', 'p.rn_bs - 1')} AS pole_volume
  FROM base p JOIN (SELECT unnest([20, 30, 40]) AS len) g ON p.rn_bs - 1 >= g.len
), best_poles AS (
  SELECT symbol, year, len, gain, pole_volume, row_number() OVER (PARTITION BY symbol, year ORDER BY gain DESC, len) AS k
  FROM poles WHERE gain > 0
), pole AS MATERIALIZED (
  SELECT b.*, q.len AS pole_len, coalesce(q.gain, 0) AS pole_gain, q.pole_volume
  FROM base b LEFT JOIN best_poles q ON q.symbol = b.symbol AND q.year = b.year AND q.k = 1
)"""

PP = f"""
pp AS MATERIALIZED (
  SELECT p.symbol, p.year, p.rn_pivot, i.close, i.low, i.volume, i.prev_close, i.close_pos, i.sma50, i.sma200, e.ema10,
    {bar('sma50', 'p.rn_pivot - 21')} AS sma50_back,
    coalesce({over('max(b.volume)', 'p.rn_pivot - 10', 'p.rn_pivot - 1', 'b.close < b.prev_close')}, 0) AS down_vol,
    {over('count(*)', 'p.rn_pivot - 10', 'p.rn_pivot - 1', 'b.close < b.prev_close')} AS down_days
  FROM pivots p JOIN ind i ON i.symbol = p.symbol AND i.rn = p.rn_pivot
    JOIN ema e ON e.symbol = p.symbol AND e.rn = p.rn_pivot
)"""

EP = """
ep_days AS (
  SELECT p.symbol, p.year, p.rn_pivot, i.rn, i.ts, i.open, i.low, i.prev_close, i.gap_pct, i.rel_vol
  FROM pivots p JOIN ind i ON i.symbol = p.symbol
    AND i.rn BETWEEN greatest(1, p.rn_pivot - 60) + 1 AND p.rn_pivot + 4
  WHERE i.gap_pct >= 0.05 AND i.rel_vol >= 2.5
), ep_all AS (
  SELECT d.*, count(*) AS post_bars, (max(b.high) - min(b.low)) / max(b.high) AS post_range,
    min(b.low) >= d.low * 0.98 AS held,
    (d.open - min(CASE WHEN b.rn <= d.rn + 2 THEN b.low END)) / (d.open - d.prev_close) AS gap_fill,
    coalesce(arg_min(b.close_pos, CASE WHEN b.close_pos IS NOT NULL THEN b.rn END), 0) AS post_pos
  FROM ep_days d JOIN ind b ON b.symbol = d.symbol AND b.rn BETWEEN d.rn + 1 AND least(d.rn + 10, d.rn_pivot + 5)
  GROUP BY d.symbol, d.year, d.rn_pivot, d.rn, d.ts, d.open, d.low, d.prev_close, d.gap_pct, d.rel_vol
), ep AS MATERIALIZED (
  SELECT p.symbol, p.year, e.* EXCLUDE (symbol, year, rn_pivot) FROM pivots p LEFT JOIN (
    SELECT *, row_number() OVER (PARTITION BY symbol, year ORDER BY gap_pct * rel_vol DESC, rn) AS k FROM ep_all) e
    ON e.symbol = p.symbol AND e.year = p.year AND e.k = 1
)"""

GO = """
go_days AS (
  SELECT p.symbol, p.year, i.rn, i.ts, i.gap_pct, i.rel_vol, i.close > i.open AS above_open, i.low > i.prev_close AS unfilled,
    coalesce(i.close_pos, 0.5) AS go_pos
  FROM pivots p JOIN ind i ON i.symbol = p.symbol AND i.rn BETWEEN greatest(1, p.rn_pivot - 60) + 1 AND p.rn_pivot
  WHERE i.gap_pct >= 0.10 AND i.rel_vol >= 3.0
), go AS MATERIALIZED (
  SELECT p.symbol, p.year, g.* EXCLUDE (symbol, year), g.above_open AND g.unfilled AS gate FROM pivots p LEFT JOIN (
    SELECT *, row_number() OVER (PARTITION BY symbol, year
      ORDER BY (above_open AND unfilled) DESC, gap_pct * rel_vol DESC, rn) AS k FROM go_days) g
    ON g.symbol = p.symbol AND g.year = p.year AND g.k = 1
)"""

# criteria: (name, points, condition); a null condition is not recorded
VCP = (
    "SELECT * FROM base JOIN contr USING (symbol, year)",
    [
        ("prior_uptrend_20", 30, "coalesce(prior_gain >= 0.20, false)"),
        ("duration_ok", 10, "base_len BETWEEN 10 AND 65"),
        ("has_contractions", 10, "n_contr >= 2"),
        ("contractions_decreasing", 10, "n_contr >= 2 AND n_rises <= 1"),
        ("final_contraction_tight", 10, "coalesce(last_contr < 0.10, false)"),
        ("aplus_final_5pct", 5, "CASE WHEN last_contr < 0.05 THEN true END"),
        ("vdu_right_side", 5, "last10_volume < base_volume * 0.75"),
        ("breakout_vol_surge", 10, "rel_vol >= 1.5"),
        ("aplus_breakout_2x", 5, "CASE WHEN rel_vol >= 2 THEN true END"),
        ("breakout_close_upper_half", 5, "coalesce(close_pos >= 0.5, false)"),
        ("near_52w_high", 5, "CASE WHEN rn_pivot >= 60 THEN (high_252 - close) / high_252 <= 0.05 END"),
    ],
    "n_contr >= 2 AND coalesce(last_contr < 0.10, false)", 60,
)
FLAT = (
    "SELECT * FROM base",
    [
        ("prior_advance_30", 30, "coalesce(prior_gain >= 0.30, false)"),
        ("duration_5w", 15, "base_len >= 25"),
        ("depth_under_15", 15, "depth_pct <= 15"),
        ("horizontal_slope", 15, "slope_ratio < 0.002"),
        ("breakout_vol_14x", 15, "rel_vol >= 1.4"),
        ("aplus_depth_10", 5, "CASE WHEN depth_pct <= 10 THEN true END"),
        ("aplus_sma50_rising", 5, "CASE WHEN end_sma50 > start_sma50 THEN true END"),
    ],
    "depth_pct <= 15 AND slope_ratio < 0.002", 60,
)
_CUP_OK = "rn_bs - 1 >= 35 AND rn_edge IS NOT NULL"
CUP_RULES = (
    "SELECT * FROM cup",
    [
        ("cup_history_too_short", 0, "CASE WHEN rn_bs - 1 < 35 THEN false END"),
        ("found_cup_left_edge", 10, "CASE WHEN rn_bs - 1 >= 35 THEN rn_edge IS NOT NULL END"),
        ("prior_uptrend_30", 30, f"CASE WHEN {_CUP_OK} THEN edge_gain >= 0.30 END"),
        ("cup_duration_7w", 10, f"CASE WHEN {_CUP_OK} THEN cup_days >= 35 END"),
        ("cup_depth_33", 10, f"CASE WHEN {_CUP_OK} THEN (cup_high - cup_low) / cup_high <= 0.33 END"),
        ("u_shape", 5, f"CASE WHEN {_CUP_OK} THEN bottom_bars >= 15 END"),
        ("handle_depth_15", 10, f"CASE WHEN {_CUP_OK} THEN handle_depth <= 0.15 END"),
        ("handle_upper_half", 10, f"CASE WHEN {_CUP_OK} THEN base_low >= (cup_high + cup_low) / 2 END"),
        ("breakout_vol_15x", 10, f"CASE WHEN {_CUP_OK} THEN rel_vol >= 1.5 END"),
        ("aplus_handle_above_50sma", 5, f"CASE WHEN {_CUP_OK} AND base_low >= start_sma50 THEN true END"),
    ],
    f"{_CUP_OK} AND handle_depth <= 0.15 AND base_low >= (cup_high + cup_low) / 2", 60,
)
_W = "rn_pivot >= 20 AND rn2 IS NOT NULL AND peak IS NOT NULL"
_RALLY = "(peak - price1) / price1 BETWEEN 0.10 AND 0.30"
DOUBLE = (
    "SELECT * FROM wave",
    [
        ("window_too_short", 0, "CASE WHEN rn_pivot < 20 THEN false END"),
        ("two_lows_found", 10, "CASE WHEN rn_pivot >= 20 THEN rn2 IS NOT NULL END"),
        ("middle_peak", 0, "CASE WHEN rn_pivot >= 20 AND rn2 IS NOT NULL AND peak IS NULL THEN false END"),
        ("prior_context", 30, f"CASE WHEN {_W} AND gain1 >= 0 THEN true END"),
        ("lows_within_5pct", 10, f"CASE WHEN {_W} THEN apart <= 0.05 END"),
        ("middle_peak_rally_10_30", 10, f"CASE WHEN {_W} THEN {_RALLY} END"),
        ("4w_between_lows", 10, f"CASE WHEN {_W} THEN rn2 - rn1 >= 20 END"),
        ("breakout_above_middle_peak", 10, f"CASE WHEN {_W} THEN close > peak END"),
        ("breakout_vol_15x", 10, f"CASE WHEN {_W} THEN rel_vol >= 1.5 END"),
        ("aplus_undercut", 5, f"CASE WHEN {_W} AND price2 < price1 AND price2 > price1 * 0.95 THEN true END"),
    ],
    f"{_W} AND apart <= 0.05 AND {_RALLY} AND close > peak", 60,
)
_POLE = "rn_bs - 1 >= 20 AND pole_gain >= 1"
HTF = (
    "SELECT * FROM pole",
    [
        ("flag_start_nan", 0, "CASE WHEN NOT coalesce(start_close > 0, false) THEN false END"),
        ("insufficient_pole_history", 0, "CASE WHEN rn_bs - 1 < 20 THEN false END"),
        ("pole_100_in_4_8w", 30, "CASE WHEN rn_bs - 1 >= 20 THEN pole_gain >= 1 END"),
        ("flag_depth_25", 10, f"CASE WHEN {_POLE} THEN depth_pct <= 25 END"),
        ("flag_volume_contraction", 10, f"CASE WHEN {_POLE} THEN base_volume < pole_volume * 0.6 END"),
        ("breakout_vol_14x", 10, f"CASE WHEN {_POLE} THEN rel_vol >= 1.4 END"),
        ("aplus_flag_depth_15", 5, f"CASE WHEN {_POLE} AND depth_pct <= 15 THEN true END"),
        ("aplus_pole_100_6w", 5, f"CASE WHEN {_POLE} AND pole_len <= 30 THEN true END"),
    ],
    f"{_POLE} AND depth_pct <= 25", 60,
)
_ABOVE = "rn_pivot >= 22 AND coalesce(close > sma200, false)"
_NEAR = "(abs(low - ema10) / ema10 <= 0.02 OR coalesce(abs(low - sma50) / sma50 <= 0.03, false))"
POCKET = (
    "SELECT * FROM pp",
    [
        ("history_too_short", 0, "CASE WHEN rn_pivot < 22 THEN false END"),
        ("above_sma200", 30, "CASE WHEN rn_pivot >= 22 THEN coalesce(close > sma200, false) END"),
        ("up_day", 10, f"CASE WHEN {_ABOVE} THEN close > prev_close END"),
        ("vol_beats_10d_downvol", 10, f"CASE WHEN {_ABOVE} THEN volume > down_vol AND volume > 0 END"),
        ("close_upper_two_thirds", 10, f"CASE WHEN {_ABOVE} THEN coalesce(close_pos >= 0.33, false) END"),
        ("near_ma", 10, f"CASE WHEN {_ABOVE} THEN {_NEAR} END"),
        ("rising_sma50", 5, f"CASE WHEN {_ABOVE} THEN coalesce(sma50 > sma50_back, false) END"),
        ("aplus_close_top_quarter", 5, f"CASE WHEN {_ABOVE} AND close_pos >= 0.75 THEN true END"),
    ],
    f"{_ABOVE} AND volume > down_vol AND volume > 0 AND coalesce(close_pos >= 0.33, false) AND {_NEAR}", 60,
)
_EP = "rn IS NOT NULL"
EPISODIC = (
    "SELECT * FROM ep",
    [
        ("qualifying_gap", 30, _EP),
        ("gap_gte_10pct", 10, "gap_pct >= 0.10"),
        ("rel_vol_gte_3x", 10, "rel_vol >= 3"),
        ("post_gap_held_above_gap_low", 10, "held"),
        ("tight_consolidation", 10, "CASE WHEN post_range <= 0.10 THEN true WHEN post_range > 0.15 THEN false END"),
        ("moderate_consolidation", 5, "CASE WHEN post_range > 0.10 AND post_range <= 0.15 THEN true END"),
        ("aplus_gap_gte_15pct", 5, "CASE WHEN gap_pct >= 0.15 THEN true END"),
        ("aplus_vol_gte_5x", 5, "CASE WHEN rel_vol >= 5 THEN true END"),
        ("aplus_gap_fill_lt_30pct", 5, "gap_fill < 0.30"),
        ("aplus_close_top_25pct", 5, "CASE WHEN post_pos >= 0.75 THEN true END"),
    ],
    f"{_EP} AND held", 60,
)
GAP_GO = (
    "SELECT * FROM go",
    [
        ("qualifying_gap", 0, "CASE WHEN rn IS NULL THEN false END"),
        ("gate_passed", 30, "CASE WHEN gate THEN true END"),
        ("gap_gte_10pct", 0, "CASE WHEN NOT gate THEN gap_pct >= 0.10 END"),
        ("vol_gte_3x", 0, "CASE WHEN NOT gate THEN rel_vol >= 3 END"),
        ("close_above_open", 0, "CASE WHEN NOT gate THEN above_open END"),
        ("low_above_prior_close", 0, "CASE WHEN NOT gate THEN unfilled END"),
        ("gap_gte_20pct", 10, "gap_pct >= 0.20"),
        ("vol_gte_5x", 10, "rel_vol >= 5"),
        ("close_top_50pct", 10, "go_pos >= 0.50"),
        ("aplus_gap_gte_30pct", 5, "CASE WHEN gap_pct >= 0.30 THEN true END"),
        ("aplus_vol_gte_8x", 5, "CASE WHEN rel_vol >= 8 THEN true END"),
    ],
    "rn IS NOT NULL AND gate", 50,
)

RULES = {
    "VCP": VCP, "Flat Base": FLAT, "Cup with Handle": CUP_RULES, "Double Bottom": DOUBLE,
    "HTF": HTF, "Pocket Pivot": POCKET, "Episodic Pivot": EPISODIC, "Gap & Go": GAP_GO,
}


def detector(setup: str) -> str:
    source, criteria, match, floor = RULES[setup]
    score = " + ".join(f"CASE WHEN {c} THEN {points} ELSE 0 END" for _, points, c in criteria)
    text = " || ".join(
        f"CASE WHEN ({c}) IS NULL THEN '' WHEN {c} THEN '{name}=true;' ELSE '{name}=false;' END" for name, _, c in criteria
    )
    return (f"SELECT symbol, year, '{setup}' AS setup, least({score}, 100) AS score, "
            f"coalesce(({score}) >= {floor} AND ({match}), false) AS matched, {text} AS criteria FROM ({source})")


ALL_FEATURES = (BASE, CONTRACTIONS, CUP, WAVE, POLE, PP, EP, GO)
TO_PIVOTS = (BARS, IND, MOVES, PIVOTS)
ORDERED = list(RULES)

DETECTED = "detected AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT *, {i} AS ord FROM ({detector(s)})" for i, s in enumerate(ORDERED)) + ")"

# losers go out pair by pair, in order; only then are the demoted set aside
RESOLVED = """
hits AS (
  SELECT symbol, year, list(setup) FILTER (matched) AS m0, max(score) AS top FROM detected GROUP BY ALL
), t1 AS (SELECT *, CASE WHEN list_contains(m0, 'HTF') THEN list_filter(m0, lambda x: x <> 'VCP') ELSE m0 END AS m1 FROM hits
), t2 AS (SELECT *, CASE WHEN list_contains(m1, 'HTF') THEN list_filter(m1, lambda x: x <> 'Cup with Handle') ELSE m1 END AS m2 FROM t1
), t3 AS (SELECT *, CASE WHEN list_contains(m2, 'Cup with Handle') THEN list_filter(m2, lambda x: x <> 'VCP') ELSE m2 END AS m3 FROM t2
), t4 AS (SELECT *, CASE WHEN list_contains(m3, 'Flat Base') THEN list_filter(m3, lambda x: x <> 'VCP') ELSE m3 END AS m4 FROM t3
), t5 AS (SELECT *, CASE WHEN list_contains(m4, 'Episodic Pivot') THEN list_filter(m4, lambda x: x <> 'Gap & Go') ELSE m4 END AS m5 FROM t4
), t6 AS (SELECT *, list_filter(m5, lambda x: x NOT IN ('Pocket Pivot', 'Gap & Go')) AS strong FROM t5
), final AS (SELECT symbol, year, top, CASE WHEN len(strong) > 0 THEN strong ELSE m5 END AS live FROM t6
), winners AS (
  SELECT d.symbol, d.year, d.setup, row_number() OVER (PARTITION BY d.symbol, d.year ORDER BY d.score DESC, d.ord) AS k
  FROM detected d JOIN final f ON f.symbol = d.symbol AND f.year = d.year AND list_contains(f.live, d.setup)
), resolved AS MATERIALIZED (
  SELECT f.symbol, f.year, w.setup AS ai_primary, w.setup IS NULL OR f.top < 60 AS needs_review, f.top
  FROM final f LEFT JOIN winners w ON w.symbol = f.symbol AND w.year = f.year AND w.k = 1
)"""
CLASSIFIED = """
classified AS MATERIALIZED (
  SELECT m.symbol, m.year, m.symbol || '_' || m.year AS move_key, r.ai_primary, coalesce(r.needs_review, true) AS needs_review,
    CASE WHEN r.symbol IS NULL THEN 'no_pivot' END AS reason, coalesce(r.top, 0) AS top
  FROM moves m LEFT JOIN resolved r ON r.symbol = m.symbol AND r.year = m.year
)"""

INSIDE = """
inside AS MATERIALIZED (
  SELECT m.symbol, m.year, i.rn - m.rn_lo AS pos, m.n_bars, i.* EXCLUDE (symbol), e.ema10, e.ema20
  FROM moves m JOIN ind i ON i.symbol = m.symbol AND i.rn BETWEEN m.rn_lo AND m.rn_hi
    JOIN ema e ON e.symbol = m.symbol AND e.rn = i.rn
)"""
TO_CLASSIFIED = (BARS, EMA, IND, SWINGS, MOVES, PIVOTS, *ALL_FEATURES, DETECTED, RESOLVED, CLASSIFIED)
TO_INSIDE = (BARS, EMA, IND, MOVES, INSIDE)


def stats_cte(name: str = "stats", source: str = "inside", keys: str = "symbol, year") -> str:
    return f"""
{name}_top AS (
  SELECT *, (low - max(close) OVER w) / max(close) OVER w AS dd FROM {source}
  WINDOW w AS (PARTITION BY {keys} ORDER BY rn ROWS UNBOUNDED PRECEDING)
), {name} AS MATERIALIZED (
  SELECT {keys}, count(*) AS days, 100.0 * count(*) FILTER (close >= ema10) / count(*) AS ema10_pct,
    100.0 * count(*) FILTER (close >= ema20) / count(*) AS ema20_pct,
    count(*) FILTER (abs(close - sma50) / sma50 < 0.03) AS sma50_touches,
    count(*) FILTER (close < sma50) AS days_below_50, min(dd) * 100 AS worst_dd_pct,
    count(*) FILTER (dd < -0.1) AS days_u10, 100.0 * count(*) FILTER (dd < -0.1) / count(*) AS pct_u10,
    avg(adr_pct_20) AS adr, first(close ORDER BY rn) AS px_start, last(close ORDER BY rn) AS px_end,
    min(low) AS low, max(high) AS high, min(ts) AS first_ts, max(ts) AS last_ts
  FROM {name}_top GROUP BY {keys}
)"""


GAPS = """
gaps AS MATERIALIZED (
  SELECT *, CASE WHEN close_pct > 70 THEN 'REAL' WHEN close_pct < 30 THEN 'TRAP' ELSE 'MID' END AS label FROM (
    SELECT symbol, year, rn, ts, gap_pct * 100 AS gap_pct, rel_vol_20, coalesce(close_pos * 100, 50) AS close_pct FROM (
      SELECT * EXCLUDE (gap_pct), (open - lag(close) OVER w) / lag(close) OVER w AS gap_pct,
        volume / CASE WHEN count(*) OVER (w ROWS 19 PRECEDING) = 20 THEN avg(volume) OVER (w ROWS 19 PRECEDING) END
          AS rel_vol_20
      FROM inside WINDOW w AS (PARTITION BY symbol, year ORDER BY rn))
    WHERE gap_pct * 100 >= 5 AND rel_vol_20 >= 1.5)
)"""
STREAKS = """
marks AS (
  SELECT symbol, year, rn, ts, rn - row_number() OVER (PARTITION BY symbol, year ORDER BY rn) AS island
  FROM inside WHERE close >= ema10
), runs AS (
  SELECT symbol, year, island, count(*) AS n, min(rn) AS rn_start, min(ts) AS s, max(ts) AS e FROM marks GROUP BY ALL
), streaks AS MATERIALIZED (
  SELECT symbol, year, s AS streak_start, e AS streak_end, n AS streak_days, n // 5 AS streak_weeks
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol, year ORDER BY n DESC, rn_start) AS k FROM runs) WHERE k = 1
)"""
SCREEN = """
screen AS MATERIALIZED (
  SELECT *, CASE misses WHEN 0 THEN 'pass' WHEN 1 THEN 'review' ELSE 'skip' END AS screen FROM (
    SELECT *, (NOT trend_ok)::INT + (NOT touches_ok)::INT + (NOT adr_ok)::INT + (NOT gap_ok)::INT + (NOT streak_ok)::INT
      AS misses FROM (
      SELECT t.symbol, t.year, t.ema10_pct >= 70 AS trend_ok, t.sma50_touches < 10 AS touches_ok,
        coalesce(t.adr < 7, false) AS adr_ok,
        EXISTS (SELECT 1 FROM gaps g WHERE g.symbol = t.symbol AND g.year = t.year AND g.close_pct > 70) AS gap_ok,
        EXISTS (SELECT 1 FROM streaks k WHERE k.symbol = t.symbol AND k.year = t.year AND k.streak_weeks >= 8) AS streak_ok
      FROM stats t))
)"""


def with_(ctes: Sequence[str], select: str) -> str:
    return "WITH RECURSIVE " + ", ".join(c.strip() for c in ctes) + " " + select

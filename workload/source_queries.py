"""Queries for readers, cleaners, writers and the stream.

Files are written from the driver's tables to the shared folder, in the layouts the
readers have to cope with, and read back.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from tidebars.functions import parsing
from tidebars.operators import analytics as a
from tidebars.operators import tables
from tidebars.operators.best_moves import rounded_moves
from tidebars.session import stage_path
from tidebars.sources import bars as sb
from tidebars.sources import documents as docs
from tidebars.sources import moves as sm
from tidebars.sources import sinks
from tidebars.sources.benchmark import read_benchmark
from tidebars.streaming import extend
from workload import sql as q
from workload import tables as t
from workload.analytics_queries import NOTES, annotations
from workload.indicator_queries import daily
from workload.registry import num, query
from workload.setup_queries import CLASSIFIED_COLUMNS, classified

r = q.r
DAY = f"{q.day('ts')} AS ts"
BAR_SELECT = f"SELECT symbol, {DAY}, open, high, low, close, volume FROM dbars"


def shown_bars(df):
    return df.select("symbol", F.date_format("ts", "yyyy-MM-dd").alias("ts"), "open", "high", "low", "close", "volume")


def raw_dates(spark, sf_dir):
    """Order dates as text in the shapes that turn up in files."""
    d = F.col("o_orderdate")
    text = (
        F.when(F.col("o_orderstatus") == "F", F.date_format(d, "MM/dd/yyyy"))
        .when(F.col("o_orderstatus") == "O", F.date_format(d, " yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.date_format(d, "M/d/yyyy"))
    )
    return t.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", text.alias("raw"))


RAW = """
raw_dates AS (
  SELECT o_orderkey, o_orderpriority, o_orderdate AS d, CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%m/%d/%Y')
    WHEN 'O' THEN ' ' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
    ELSE month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate) END AS raw,
    o_orderstatus IN ('F', 'O') OR (month(o_orderdate) > 9 AND day(o_orderdate) > 9) AS strict
  FROM orders
)"""


@query("normalize_dates", q.with_([RAW], """
SELECT o_orderkey, CASE WHEN strict THEN strftime(d, '%Y-%m-%d') END AS iso,
  CASE WHEN strict THEN strftime(d, '%Y-%m-%d') ELSE raw END AS iso_or_same, strftime(d, '%Y-%m-%d') AS padded FROM raw_dates"""))
def normalize_dates(spark, sf_dir):
    raw = F.col("raw")
    return raw_dates(spark, sf_dir).select(
        "o_orderkey", parsing.iso_text(raw).alias("iso"), parsing.iso_or_same(raw).alias("iso_or_same"),
        parsing.padded_date(raw).alias("padded"))


@query("rewrite_dates", q.with_([RAW], """
SELECT o_orderpriority, count(*) AS rows, count(*) FILTER (strict AND contains(raw, '/')) AS fixed,
  count(*) FILTER (NOT strict) AS unchanged FROM raw_dates GROUP BY o_orderpriority"""))
def rewrite_dates(spark, sf_dir):
    done = sb.normalize_dates(raw_dates(spark, sf_dir), "raw")
    return done.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("fixed"), 1)).alias("fixed"),
        F.count(F.when(F.col("raw").contains("/"), 1)).alias("unchanged"))


@query("parse_numbers", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS price FROM orders""")
def parse_numbers(spark, sf_dir):
    text = F.when(F.col("o_orderstatus") == "F", F.lit(" n/a")).otherwise(F.format_number("o_totalprice", 2))
    return t.table(spark, sf_dir, "orders").select("o_orderkey", parsing.number(text).alias("price"))


@query("parse_volumes", f"""
SELECT l_orderkey, l_linenumber, {r("CASE l_returnflag WHEN 'A' THEN floor(l_quantity) * 1e3 WHEN 'N' THEN floor(l_quantity) * 1e6 ELSE floor(l_extendedprice) END", 2)}
  AS volume, 0.0::DOUBLE AS bad FROM lineitem""")
def parse_volumes(spark, sf_dir):
    n = F.floor("l_quantity").cast("string")
    text = (
        F.when(F.col("l_returnflag") == "A", F.concat(n, F.lit("k"))).when(F.col("l_returnflag") == "N", F.concat(n, F.lit("M ")))
        .otherwise(F.format_number(F.floor("l_extendedprice"), 0))
    )
    return t.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", num(parsing.volume(text), "volume", 2), parsing.volume(F.lit("nan")).alias("bad"))


def bar_files(spark, sf_dir):
    """Daily bars as files without an index, one folder per symbol."""
    path = stage_path(spark, "bar_files")
    sinks.write_bars(daily(spark, sf_dir), path)
    return path


def mixed_files(spark, sf_dir):
    """Daily bars in three layouts: by symbol, with an index, without, and close first."""
    path = stage_path(spark, "mixed_files")
    bars = daily(spark, sf_dir)
    initial = F.substring("symbol", 1, 1)
    iso, slashed = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "MM/dd/yyyy")
    indexed = bars.filter(initial.isin("1", "2")).select(
        "symbol", F.lit("0.0").alias("Unnamed: 0"), iso.alias("DateTime"), F.col("open").alias("Open"),
        F.col("high").alias("High"), F.col("low").alias("Low"), F.col("close").alias("Close"), F.col("volume").alias("Volume"))
    bare = bars.filter(initial.isin("3", "4")).select(
        "symbol", slashed.alias("DateTime"), F.col("open").alias("Open"), F.col("high").alias("High"),
        F.col("low").alias("Low"), F.col("close").alias("Close"), F.col("volume").alias("Volume"))
    old = bars.filter(~initial.isin("1", "2", "3", "4")).select("symbol", iso.alias("date"), "close", "open", "high", "low", "volume")
    for part in (indexed, bare, old):
        part.hint("rebalance", "symbol").write.mode("append").partitionBy("symbol").option("header", True).csv(path)
    return path


@query("read_bars", q.with_([q.DAILY], BAR_SELECT))
def read_bars(spark, sf_dir):
    return shown_bars(sb.read_bars(spark, bar_files(spark, sf_dir), sb.CORE, sinks.FOLDER_SYMBOL))


@query("read_bars_mixed_layouts", q.with_([q.DAILY], BAR_SELECT))
def read_bars_mixed_layouts(spark, sf_dir):
    return shown_bars(sb.read_bars(spark, mixed_files(spark, sf_dir), sb.TOLERANT, sinks.FOLDER_SYMBOL))


@query("read_bars_for_repair", q.with_([q.DAILY], f"SELECT symbol, {DAY}, close, volume FROM dbars"))
def read_bars_for_repair(spark, sf_dir):
    df = sb.read_bars(spark, bar_files(spark, sf_dir), sb.REPAIR, sinks.FOLDER_SYMBOL)
    return shown_bars(df).select("symbol", "ts", "close", "volume")


@query("date_audit", q.with_([q.DAILY], """
SELECT symbol, CASE WHEN symbol[1] IN ('1', '2') THEN 1 ELSE 0 END AS date_col, count(*) AS rows,
  CASE WHEN symbol[1] IN ('3', '4') THEN count(*) ELSE 0 END AS slashed FROM dbars GROUP BY symbol"""))
def date_audit(spark, sf_dir):
    per_file = sb.date_audit(spark, mixed_files(spark, sf_dir), sinks.FOLDER_SYMBOL)
    return per_file.groupBy("symbol", "date_col").agg(
        F.sum("rows").alias("rows"), F.sum("slashed").alias("slashed"))


@query("read_benchmark", q.with_([q.DAILY], f"""
SELECT {q.day('ts')} AS ts, open, high, low, close * 100 AS close_cents, floor(volume / 1000) * 1000 AS volume FROM (
  SELECT ts, sum(open) AS open, sum(high) AS high, sum(low) AS low, round(sum(close), 2) AS close, sum(volume) AS volume
  FROM dbars GROUP BY ts)""".replace("close * 100", r("close * 100", 2)).replace(
      " open, high, low,", f" {r('open', 2)} AS open, {r('high', 2)} AS high, {r('low', 2)} AS low,", 1)))
def read_bench(spark, sf_dir):
    """The mean-free sum over symbols as a benchmark file with commas, slashed dates and K volumes."""
    total = daily(spark, sf_dir).groupBy("ts").agg(
        *[F.sum(c).alias(c) for c in ("open", "high", "low", "close", "volume")])
    path = stage_path(spark, "benchmark_file")
    total.select(
        F.date_format("ts", "MM/dd/yyyy").alias("Date"), F.format_number("close", 2).alias("Price"),
        *[F.format_number(c, 2).alias(c.capitalize()) for c in ("open", "high", "low")],
        F.concat(F.floor(F.col("volume") / 1000).cast("string"), F.lit("K")).alias("Vol."),
    ).write.option("header", True).csv(path)
    df = read_benchmark(spark, path)
    return df.select(F.date_format("ts", "yyyy-MM-dd").alias("ts"), num("open", places=2), num("high", places=2),
                     num("low", places=2), num(F.col("close") * 100, "close_cents", 2), "volume")


def moves_file(spark, sf_dir):
    path = stage_path(spark, "moves_file")
    moves = t.moves(spark, sf_dir).select("year", "symbol", "gain_pct", "low_date", "high_date", "low_price", "high_price", "avg_vol_b")
    sinks.write_moves(rounded_moves(moves), path)
    return path


FILE_MOVES = f"""
file_moves AS (
  SELECT year, symbol, {r('gain_pct', 2)} AS gain_pct, {q.day('low_date')} AS low_date, {q.day('high_date')} AS high_date,
    low_price, high_price, n_bars FROM moves
)"""


def shown_file_moves(df):
    return df.select("year", "symbol", num("gain_pct", places=2), F.col("low_date").cast("string").alias("low_date"),
                     F.col("high_date").cast("string").alias("high_date"), "low_price", "high_price")


@query("read_moves", q.with_((q.BARS, q.MOVES, FILE_MOVES), "SELECT * EXCLUDE (n_bars) FROM file_moves"))
def read_moves(spark, sf_dir):
    return shown_file_moves(sm.read_moves(spark, moves_file(spark, sf_dir)))


@query("filter_moves", q.with_((q.BARS, q.MOVES, FILE_MOVES), """
SELECT * EXCLUDE (n_bars) FROM file_moves WHERE year = 2820 AND symbol IN (SELECT symbol FROM moves WHERE n_bars >= 80)"""))
def filter_moves(spark, sf_dir):
    moves = sm.read_moves(spark, moves_file(spark, sf_dir))
    wanted = t.moves(spark, sf_dir).filter(F.col("n_bars") >= 80).select("symbol")
    return shown_file_moves(sm.filter_moves(moves, year=2820, symbols=wanted))


@query("missing_symbols", q.with_([q.TICKS], """
SELECT DISTINCT event_type || '_' || (user_id % 6) AS symbol FROM events
WHERE event_type || '_' || (user_id % 6) NOT IN (SELECT symbol FROM ticks)"""))
def missing_symbols(spark, sf_dir):
    """Symbols asked for under a finer split that have no bars."""
    wanted = t.table(spark, sf_dir, "events").select(F.concat_ws("_", "event_type", F.pmod("user_id", F.lit(6))).alias("symbol"))
    return sb.missing_symbols(wanted, t.bars(spark, sf_dir))


def annotation_file(spark, sf_dir):
    path = stage_path(spark, "annotations")
    annotations(spark, sf_dir).select("move_key", "direction", F.lit("").alias("notes"), "rating", "tags").write.json(path)
    return path


@query("read_annotations", q.with_((q.BARS, q.MOVES, NOTES), """
SELECT move_key, direction, rating, t AS tag FROM (
  SELECT move_key, direction, rating, unnest(CASE WHEN len(tags) = 0 THEN [NULL] ELSE tags END) AS t FROM notes)"""))
def read_annotations(spark, sf_dir):
    notes = docs.read_annotations(spark, annotation_file(spark, sf_dir), "lines")
    return docs.explode_tags(notes).join(notes.select("move_key", "direction", "rating"), "move_key").select(
        "move_key", "direction", "rating", "tag")


@query("event_properties", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def event_properties(spark, sf_dir):
    props = F.from_json("props", "map<string,bigint>")
    return t.table(spark, sf_dir, "events").select("event_id", F.explode(props).alias("key", "k")).select("event_id", "k")


def review_file(spark, sf_dir):
    """Reviews with two legs each, the second of unclear tradability."""
    def leg(i, gain, tradable):
        return F.struct(
            F.lit(i).alias("leg"), F.lit(2).alias("of"), F.lit("-").alias("period"),
            F.concat(F.lit("~"), F.round(gain, 1).cast("string"), F.lit("%")).alias("pct_gain"),
            F.lit("VCP").alias("setup"), tradable.cast("string").alias("tradable"))
    gain = F.col("gain_pct")
    legs = F.array(leg(1, gain / 2, gain >= 25), leg(2, -gain / 4, F.lit("Partially - late")))
    path = stage_path(spark, "reviews")
    t.moves(spark, sf_dir).select(
        F.concat_ws("_", "symbol", "year").alias("move_key"), "gain_pct", F.lit("2024-02-01").alias("reviewed_at"),
        legs.alias("legs")).write.json(path)
    return path


LEGS = f"""
legs AS (
  SELECT symbol || '_' || year AS move_key, 1 AS leg, {r('gain_pct / 2', 1)} AS gain_pct,
    CASE WHEN gain_pct >= 25 THEN 'yes' ELSE 'no' END AS tradable FROM moves
  UNION ALL SELECT symbol || '_' || year, 2, {r('-gain_pct / 4', 1)}, 'partial' FROM moves
)"""


@query("read_reviews", q.with_((q.BARS, q.MOVES), f"SELECT symbol || '_' || year AS move_key, {r('gain_pct')} AS gain_pct, 2 AS legs FROM moves"))
def read_reviews(spark, sf_dir):
    df = docs.read_reviews(spark, review_file(spark, sf_dir), "lines")
    return df.select("move_key", num("gain_pct"), F.size("legs").alias("legs"))


@query("review_legs", q.with_((q.BARS, q.MOVES, LEGS), "SELECT * FROM legs"))
def review_legs(spark, sf_dir):
    legs = a.legs_of(docs.read_reviews(spark, review_file(spark, sf_dir), "lines"))
    return legs.select("move_key", "leg", num("gain_pct"), "tradable")


@query("leg_rollup", q.with_((q.BARS, q.MOVES, LEGS), f"""
SELECT move_key, count(*) AS legs, count(*) FILTER (tradable = 'yes') AS tradable_legs, {r('max(gain_pct)')} AS best_gain_pct,
  {r('sum(gain_pct)')} AS sum_gain_pct FROM legs GROUP BY move_key"""))
def leg_rollup(spark, sf_dir):
    df = a.leg_rollup(a.legs_of(docs.read_reviews(spark, review_file(spark, sf_dir), "lines")))
    return df.select("move_key", "legs", "tradable_legs", num("best_gain_pct"), num("sum_gain_pct"))


@query("save_reviews", q.with_((q.BARS, q.MOVES), f"""
SELECT symbol || '_' || year AS move_key, {r('CASE WHEN gain_pct >= 25 THEN gain_pct * 3 ELSE gain_pct END')} AS gain_pct FROM moves"""))
def save_reviews(spark, sf_dir):
    """Large moves are reviewed again, twice; the second post counts."""
    reviews = t.moves(spark, sf_dir).select(F.concat_ws("_", "symbol", "year").alias("move_key"), "gain_pct")
    again = reviews.filter(F.col("gain_pct") >= 25)
    posts = again.withColumn("gain_pct", F.col("gain_pct") * 2).withColumn("saved_at", F.lit(1)).unionByName(
        again.withColumn("gain_pct", F.col("gain_pct") * 3).withColumn("saved_at", F.lit(2)))
    return tables.save_reviews(reviews, posts).select("move_key", num("gain_pct"))


@query("save_annotations", q.with_((q.BARS, q.MOVES, NOTES), """
SELECT move_key, CASE WHEN rating = 'A' THEN 'B' ELSE rating END AS rating FROM notes"""))
def save_annotations(spark, sf_dir):
    notes = annotations(spark, sf_dir).select("move_key", "rating")
    posts = notes.filter(F.col("rating") == "A").select("move_key", F.lit("B").alias("rating"), F.lit(1).alias("saved_at"))
    return tables.save_annotations(notes, posts)


@query("read_classifications", q.with_((*q.TO_CLASSIFIED,), """
SELECT c.move_key, c.ai_primary, c.needs_review, c.reason, d.setup, d.score, d.matched
FROM classified c LEFT JOIN detected d ON d.symbol = c.symbol AND d.year = c.year"""))
def read_classifications(spark, sf_dir):
    path = stage_path(spark, "classifications")
    sinks.write_classifications(classified(spark, sf_dir), path)
    done = docs.read_classifications(spark, path, "lines")
    results = docs.explode_results(done, "ai_all_detector_results").select("move_key", "setup", "score", "matched")
    return done.select(*CLASSIFIED_COLUMNS).join(results, "move_key", "left")


STREAM_SELECT = f"SELECT symbol, {DAY}, {r('close')} AS close, volume FROM dbars"


def streamed(spark, start, feeds, files_per_batch):
    """The table after each feed (a list of DataFrames, one arrival each) was drained by a query of its own."""
    table = stage_path(spark, "stream_table")
    extend.start_table(start, table)
    for arrivals in feeds:
        feed, checkpoint = stage_path(spark, "stream_feed"), stage_path(spark, "stream_checkpoint")
        for rows in arrivals:
            rows.select(*tables.BAR_COLUMNS).write.mode("append").parquet(feed)
        extend.extend_stream(extend.read_feed(spark, feed, files_per_batch), table, checkpoint, once=True).awaitTermination()
    return extend.read_table(spark, table).select("symbol", F.date_format("ts", "yyyy-MM-dd").alias("ts"), num("close"), "volume")


@query("stream_extend", q.with_([q.DAILY], STREAM_SELECT))
def stream_extend(spark, sf_dir):
    """The first five years are the table; the rest arrives as a stream that repeats itself."""
    bars = daily(spark, sf_dir)
    arrivals = [bars.filter(F.year("ts").between(1999, year)) for year in (2000, 2001)]
    return streamed(spark, bars.filter(F.year("ts") < 2000), [arrivals], 100)


def late_symbol(spark, sf_dir, files_per_batch):
    """A symbol whose bars arrive after those of all others, oldest last."""
    bars = daily(spark, sf_dir)
    late = F.col("symbol") == "5-LOW"
    arrivals = [bars.filter(~late), bars.filter(late & (F.year("ts") >= 1998)), bars.filter(late & (F.year("ts") < 1998))]
    return streamed(spark, bars.filter(~late & (F.year("ts") < 1997)), [arrivals], files_per_batch)


@query("stream_late_symbol", q.with_([q.DAILY], STREAM_SELECT))
def stream_late_symbol(spark, sf_dir):
    return late_symbol(spark, sf_dir, 1)


@query("stream_late_symbol_at_once", q.with_([q.DAILY], STREAM_SELECT))
def stream_late_symbol_at_once(spark, sf_dir):
    return late_symbol(spark, sf_dir, 100)


def bad_then_good(spark, sf_dir, files_per_batch):
    """Each bar is first sent with a negative close, then with the right one."""
    bars = daily(spark, sf_dir)
    return streamed(spark, bars.filter(F.year("ts") < 1998), [[bars.withColumn("close", -F.col("close")), bars]], files_per_batch)


@query("stream_bad_then_good", q.with_([q.DAILY], STREAM_SELECT))
def stream_bad_then_good(spark, sf_dir):
    return bad_then_good(spark, sf_dir, 1)


@query("stream_bad_then_good_at_once", q.with_([q.DAILY], STREAM_SELECT))
def stream_bad_then_good_at_once(spark, sf_dir):
    return bad_then_good(spark, sf_dir, 100)


@query("stream_two_feeds", q.with_([q.DAILY], STREAM_SELECT))
def stream_two_feeds(spark, sf_dir):
    """Two feeds with checkpoints of their own extend one table in turn."""
    bars = daily(spark, sf_dir)
    odd = F.dayofmonth("ts") % 2 == 1
    return streamed(spark, bars.filter(F.year("ts") < 1996), [[bars.filter(odd)], [bars.filter(~odd)]], 100)


@query("read_bars_odd_headers", q.with_([q.DAILY], BAR_SELECT))
def read_bars_odd_headers(spark, sf_dir):
    """No header names a close; positions decide."""
    path = stage_path(spark, "odd_files")
    daily(spark, sf_dir).select(
        "symbol", F.date_format("ts", "yyyy-MM-dd").alias("Date"), F.col("open").alias("Erst"), F.col("high").alias("Top"),
        F.col("low").alias("Tief"), F.col("close").alias("Last"), F.col("volume").alias("Vol"),
    ).hint("rebalance", "symbol").write.partitionBy("symbol").option("header", True).csv(path)
    return shown_bars(sb.read_bars(spark, path, sb.TOLERANT, sinks.FOLDER_SYMBOL))

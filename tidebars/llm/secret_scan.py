"""Secrets in every version of every file, by an incremental ledger of content-addressed blobs.

A version's text is known by its digest (SHA-256), so a blob that occurs under many paths, or again in later versions, is one blob.
The ledger is two tables under a folder: ``scanned`` (blob, rules) tells which rules, each by name and version, have read a blob, and
``findings`` (blob, rule, s, e) where they matched. ``update`` reads the texts of those blobs alone that lack a rule, and runs only
the rules that they lack: new blobs are scanned by all rules, known blobs by changed rules, everything else not at all.
``findings`` joins the ledger back to all paths and versions.

Findings are written before the blobs count as scanned: a job that dies in between scans those blobs again and finds the same rows,
which count once. Texts move only where an unseen blob has to be picked out of its copies; a small set of unseen blobs is sent to the
texts by Spark itself.

Null text counts as empty and has no findings. Rows of one path and version, repeated or with different texts, are all kept and each
gets the findings of its own text. Spans of one rule never overlap; spans of different rules may. Offsets are code points, e
exclusive. An empty table gives no rows; other columns of the input are ignored. Patterns are possessive or bounded, so texts of any
length take linear time.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebars.session import stage, stage_path

SCANNED = "blob binary, rules array<string>"
FINDINGS = "blob binary, rule string, s bigint, e bigint"


@dataclass(frozen=True)
class Rule:
    """``hints``: one of these strings is in the lower-cased text, or no match is possible. Matches whose ``group`` has fewer than
    ``least`` characters are dropped. Raise ``version`` when any of it changes."""
    name: str
    version: int
    pattern: str
    hints: tuple[str, ...] = ()
    group: int = 0
    least: int = 1

    @property
    def id(self) -> str:
        return f"{self.name}@{self.version}"


#: The first three are the base rules; the others are formats of keys that their issuers document.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""",
         ("password", "passwd", "secret", "token", "apikey", "api_key"), 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]++", ("akia",), 0, 20),
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{24,}+"),
    Rule("private_key", 1, r"-----BEGIN [A-Z0-9\x20]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END [A-Z0-9\x20]{0,40}PRIVATE KEY-----)?",
         ("private key-----",)),
    Rule("github", 1, r"gh[oprsu]_[A-Za-z0-9]{36,}+", ("gho_", "ghp_", "ghr_", "ghs_", "ghu_")),
    Rule("slack", 1, r"xox[abeoprs]-[A-Za-z0-9-]{10,}+", ("xox",)),
    Rule("google", 1, r"AIza[A-Za-z0-9_-]{35}", ("aiza",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]*+", ("eyj",)),
    Rule("url_password", 1, r"://[^\s/:@]{1,64}:[^\s/@]{1,128}@", ("://",)),
    Rule("bearer", 1, r"(?i)bearer\x20++[A-Za-z0-9._~+/=-]{20,}+", ("bearer",)),
)
BASE = ("assign", "access", "hex")


def blob_of(text: str = "text") -> Column:
    """Content address of a text."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def start(spark: SparkSession, ledger: str) -> None:
    """Create an empty ledger."""
    spark.createDataFrame([], SCANNED).write.parquet(f"{ledger}/scanned")
    spark.createDataFrame([], FINDINGS).write.parquet(f"{ledger}/findings")


def addresses(versions: DataFrame) -> DataFrame:
    """path, version and blob of each row, without its text."""
    return versions.select("path", "version", blob_of().alias("blob"))


def unseen(addressed: DataFrame, ledger: str, rules: Sequence[Rule]) -> DataFrame:
    """Blobs that lack a rule: (blob, path, version, todo), path and version naming one of their places."""
    spark = addressed.sparkSession
    places = addressed.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("place"))
    seen = spark.read.schema(SCANNED).parquet(f"{ledger}/scanned").select("blob", F.explode("rules").alias("rule"))
    seen = seen.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    every = F.array(*(F.lit(r.id) for r in rules))
    todo = F.coalesce(F.array_except(every, "seen"), every)
    return places.join(seen, "blob", "left").select("blob", "place.path", "place.version", todo.alias("todo")).where(F.size("todo") > 0)


def _matches(rule: Rule) -> Column:
    """Array of (gap, length, kept) of a rule's matches, null without any."""
    pattern = F.lit(rule.pattern)
    wanted = F.array_contains("todo", rule.id)
    if rule.hints:
        hinted = F.lit(False)
        for hint in rule.hints:
            hinted = hinted | F.contains("lower", F.lit(hint))
        wanted = wanted & hinted
    found = F.regexp_extract_all("text", pattern, F.lit(0))
    gaps = F.transform(F.split("text", rule.pattern, -1), F.length)
    lengths = F.transform(found, F.length)
    tested = lengths if rule.group == 0 else F.transform(F.regexp_extract_all("text", pattern, F.lit(rule.group)), F.length)
    rows = F.zip_with(F.zip_with(gaps, lengths, lambda g, n: F.struct(g.alias("gap"), n.alias("len"))), tested, lambda x, t: F.struct(
        x["gap"].cast("long").alias("gap"), x["len"].cast("long").alias("len"), (t >= rule.least).alias("kept")))
    return F.when(wanted & F.regexp_like("text", pattern), rows)


def scan(texts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Findings of (blob, text, todo): each text is read by the rules of its ``todo``."""
    texts = texts.select("blob", "text", "todo", F.lower("text").alias("lower"))
    kinds = F.array(*(F.struct(F.lit(r.id).alias("rule"), _matches(r).alias("m")) for r in rules))
    hits = texts.select("blob", F.explode(F.filter(kinds, lambda k: k["m"].isNotNull())).alias("k"))
    hits = hits.select("blob", "k.rule", F.posexplode("k.m").alias("i", "x")).where(F.col("x.len").isNotNull())
    upto = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("x.gap") + F.col("x.len")).over(upto)
    return hits.withColumn("e", end).where("x.kept").select("blob", "rule", (F.col("e") - F.col("x.len")).alias("s"), "e")


def update(versions: DataFrame, ledger: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Scan what the ledger lacks of ``versions`` (path, version, text); gives the addresses of all rows, as a staged table."""
    versions = versions.select("path", "version", "text")
    addressed = stage(addresses(versions), "blob_addresses")
    todo = stage(unseen(addressed, ledger, rules), "unseen_blobs")
    named = versions.withColumn("blob", blob_of())
    same = F.col("v.blob").eqNullSafe(F.col("t.blob"))
    for c in ("path", "version"):
        same = same & F.col(f"v.{c}").eqNullSafe(F.col(f"t.{c}"))
    texts = named.alias("v").join(todo.alias("t"), same).select("v.blob", "v.text", "t.todo").where("text <> ''")
    # a repeated row gives its findings again: once is enough
    scan(texts, rules).distinct().write.mode("append").parquet(f"{ledger}/findings")
    todo.select("blob", F.col("todo").alias("rules")).write.mode("append").parquet(f"{ledger}/scanned")
    return addressed


def findings(addressed: DataFrame, ledger: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(path, version, blob) with ``spans``: array of (kind, s, e) of the given rules, by start, then rule as listed."""
    order = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.id), F.struct(F.lit(i).alias("i"), F.lit(r.name).alias("kind")))))
    known = addressed.sparkSession.read.schema(FINDINGS).parquet(f"{ledger}/findings").where(F.col("rule").isin([r.id for r in rules]))
    known = known.distinct().withColumn("r", order[F.col("rule")])
    spans = known.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("s", "r.i", "r.kind", "e"))).alias("x"))
    spans = stage(spans.select("blob", F.transform("x", lambda y: F.struct(y["kind"].alias("kind"), y["s"].alias("s"), y["e"].alias("e"))).alias("spans")),
                  "blob_spans")
    none = F.expr("cast(array() as array<struct<kind:string,s:bigint,e:bigint>>)")
    return addressed.join(spans, "blob", "left").select("path", "version", "blob", F.coalesce("spans", none).alias("spans"))


def of_kinds(kinds: Sequence[str]) -> Column:
    return F.filter("spans", lambda x: x["kind"].isin(list(kinds)))


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat(x["kind"], F.lit(":"), x["s"], F.lit(":"), x["e"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """One row per document, each a path with one version: base counts, the digest of base spans, and all spans."""
    ledger = stage_path(docs.sparkSession, "blob_ledger")
    start(docs.sparkSession, ledger)
    versions = docs.select(F.col("doc_id").alias("path"), F.lit(1).alias("version"), "text")
    found = findings(update(versions, ledger), ledger)
    count = [F.size(of_kinds([k])).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(F.col("path").alias("doc_id"), *count, F.sha2(joined(of_kinds(BASE)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))

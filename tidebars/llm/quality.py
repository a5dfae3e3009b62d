"""Quality rules with risk-controlled thresholds, in built-in SQL functions only.

Base counts of a text decide its base verdict. The method adds one rule per measure (symbols a word, share of repeated
words, share of repeated lines, length of a word): a text fails a rule when its measure is beyond the rule's cutoff.
Cutoffs are learned from labelled texts. They are grouped in strata (the language of a text, null apart), and for every rule,
stratum and candidate cutoff the false rejections among good texts are counted. A cutoff is safe when the hypothesis
"it rejects at least ``RISK`` of good texts" is refuted by the exact binomial test at level ``DELTA / (rules * strata)``. Within a
rule and stratum the cutoffs are tested in a fixed sequence, from the loosest inwards, up to the first that is not refuted, which
needs no correction of its own; over rules and strata Bonferroni's makes all chosen cutoffs hold together with confidence
``1 - DELTA``. The strictest safe cutoff of a rule applies; where none is safe the rule rejects nothing there.

Null text has no words (counts 0, base_failed). Labels that are null, or contradict each other for one document, are not used;
repeated labels count once. Repeated rows get equal results. No labels: only the base verdict. Strata without good labels: only
the base verdict. Extra columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.llm.common import SPACE, SPACES
from tidebars.session import stage

RISK = 0.02
DELTA = 0.05
MIN_WORDS = 50
#: Measure and its candidate cutoffs, strictest first; a text fails when the measure is above the cutoff.
RULES = {
    "symbol_ratio": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0, 2.0),
    "repeat_ratio": (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5),
    "dup_line_ratio": (0.1, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.7),
    "word_length": (5.5, 6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0),
}


def counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the base counts n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words."""
    df = docs.select(*keep, F.coalesce("text", F.lit("")).alias("t"))
    df = df.withColumn("flat", F.btrim(F.regexp_replace("t", SPACE, " "), F.lit(" ")))
    df = df.withColumn("w", F.expr("case when flat = '' then cast(array() as array<string>) else split(flat, ' ') end"))
    df = df.withColumn("lines", F.expr(f"filter(split(t, '\\n'), x -> translate(x, {SPACES}, '') <> '')"))
    df = df.withColumns({
        "n_words": F.size("w").cast("long"),
        "word_chars": F.length(F.replace("flat", F.lit(" "), F.lit(""))).cast("long"),
        "n_symbols": (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long"),
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        # windows of three words as hashes; their places are needed only where some window comes twice
        "h": F.expr("case when size(w) >= 4 then transform(slice(w, 1, size(w) - 2), (x, i) -> xxhash64(x, w[i + 1], w[i + 2])) end"),
    })
    df = df.drop("t", "flat", "lines", "w")
    df = df.withColumn("s", F.expr(
        "case when size(array_distinct(h)) < size(h) then array_sort(transform(h, (x, i) -> struct(x as x, i as i))) end"))
    df = df.withColumn("p", F.expr(
        "transform(filter(transform(s, (y, k) -> struct(y.i as i, (k > 0 and s[greatest(k - 1, 0)].x = y.x) or "
        "(k < size(s) - 1 and s[least(k + 1, size(s) - 1)].x = y.x) as twice)), y -> y.twice), y -> y.i)"))
    repeat = F.expr("case when p is null then 0 else size(array_distinct(concat(p, transform(p, i -> i + 1), transform(p, i -> i + 2)))) end")
    return df.withColumn("n_repeat_words", repeat.cast("long")).drop("h", "s", "p")


def _measures() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbol_ratio": F.col("n_symbols") / words,
        "repeat_ratio": F.col("n_repeat_words") / words,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "word_length": F.col("word_chars") / words,
    }


def _log_factorial(n: str) -> str:
    """SQL: ln n!, by Stirling's series for n + 10, taken down again."""
    x = f"({n} + 11.0D)"
    series = (f"(({x} - 0.5D) * ln({x}) - {x} + 0.9189385332046727D + 1.0D / (12 * {x}) - 1.0D / (360 * {x} * {x} * {x})"
              f" + 1.0D / (1260 * power({x}, 5)))")
    return f"({series} - ln(" + " * ".join(f"({n} + {i}.0D)" for i in range(1, 11)) + "))"


def binomial_below(k: str, n: str, risk: float) -> Column:
    """P(X <= k) for X binomial(n, risk): the largest term by logarithms, the smaller ones by their ratios downwards.

    Exact up to rounding where k is below the mean, which is where it can be small; 1 at or above the mean.
    """
    top = (f"exp({_log_factorial(n)} - {_log_factorial(k)} - {_log_factorial(f'({n} - {k})')} + {k} * ln({risk}D)"
           f" + ({n} - {k}) * ln({1 - risk}D))")
    # terms fall at least geometrically below the mean; 64 * sqrt(n) of them hold all but rounding
    steps = f"least({k}, cast(64 * sqrt({n}) as bigint))"
    tail = (f"aggregate(case when {steps} < 1 then cast(array() as array<bigint>) else sequence(0L, {steps} - 1) end, named_struct('term', 1.0D, 'sum', 1.0D), "
            f"(acc, j) -> named_struct('term', acc.term * ({k} - j) * {1 - risk}D / (({n} - {k} + j + 1) * {risk}D), "
            f"'sum', acc.sum + acc.term * ({k} - j) * {1 - risk}D / (({n} - {k} + j + 1) * {risk}D)), acc -> acc.sum)")
    return F.expr(f"case when {k} >= {n} * {risk}D then 1.0D else least(1.0D, {top} * {tail}) end")


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row per stratum with a cutoff per rule (null: none is safe).

    ``measured``: doc_id, stratum and the measures; ``labels``: doc_id, quality.
    """
    good = (labels.where("quality is not null and doc_id is not null").groupBy("doc_id")
            .agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).where("lo = 1 and hi = 1").select("doc_id"))
    held = measured.join(good, "doc_id", "left_semi")
    # partial sums on the map side: one row per stratum, rule and cutoff
    sums = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *(
        F.sum((F.col(r) > c).cast("long")).alias(f"bad_{r}_{j}") for r, cs in RULES.items() for j, c in enumerate(cs)))
    flat = sums.select("stratum", "n", F.explode(F.array(*(
        F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"bad_{r}_{j}").alias("bad"))
        for r, cs in RULES.items() for j, c in enumerate(cs)))).alias("x")).select("stratum", "n", "x.*")
    tests = held.agg(F.count_distinct("stratum")).first()[0] * len(RULES)
    # a stricter cutoff rejects what a looser one does and more, so the cutoffs before the first that fails are those that pass
    safe = flat.where(binomial_below("bad", "n", risk) <= F.lit(delta / max(tests, 1)))
    return safe.groupBy("stratum").agg(*(F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES))


def apply(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Counts, measures, base_failed, the rules failed, and kept, for each document."""
    measured = counts(docs, ["doc_id", F.coalesce("lang", F.lit("")).alias("stratum")])
    measured = stage(measured.withColumns(_measures()), "measures")
    found = cutoffs(measured, labels, risk, delta)
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    out = measured.join(found, "stratum", "left").withColumn("base_failed", base)
    failed = F.array_compact(F.array(*(F.when(F.col(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES)))
    out = out.withColumn("failed_rules", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return apply(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("failed_rules", ",").alias("failed_rules"))

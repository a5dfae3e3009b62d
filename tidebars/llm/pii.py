"""Personal data in texts, with built-in SQL functions only.

A regular expression proposes spans per kind, a checksum or a range test confirms them, and context words beside a
span raise or lower its score. Base kinds (email, ip, card, phone) are kept when confirmed, whatever their score;
added kinds (iban, short_card, local_phone) are kept from ``MIN_SCORE`` on. An IBAN has the length of its country, in capitals,
with or without single blanks.

Null text counts as empty and has no spans. Spans of one kind never overlap; spans of different kinds may. Ties and
repeated rows give equal rows; other columns of the input are ignored. Texts of any length take linear time: the
patterns are possessive and start only where a run starts, and offsets are summed in blocks.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SCORE = 0.5
CONTEXT = 40     # characters looked at before and after a span
BLOCK = 64       # spans summed at a time


@dataclass(frozen=True)
class Kind:
    """``hint``: a cheap test that must hold before the pattern is tried. ``valid``, ``prior``: SQL over the match m."""
    name: str
    hint: str
    pattern: str
    valid: str
    prior: float
    words: str
    base: bool = True


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


#: mod 97 of an IBAN: its first four characters go to the end, letters become 10 to 35.
_MOD97 = (
    "aggregate(split(concat(substring(translate(m, ' ', ''), 5), left(translate(m, ' ', ''), 4)), ''), 0, (acc, c) -> "
    "case when c = '' then acc when c between '0' and '9' then (acc * 10 + ascii(c) - 48) % 97 "
    "else (acc * 100 + ascii(c) - 55) % 97 end) = 1"
)

#: Countries by the length of their IBANs.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN = "|".join(f"(?:{names.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, names in _IBAN_LENGTHS.items())

KINDS = (
    Kind("email", "contains(text, '@')",
         r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         "true", 0.8, "mail|contact|kontakt|correo|courriel"),
    Kind("ip", r"text rlike '[0-9]\\.[0-9]'", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
         r"forall(split(m, '\\.'), p -> coalesce(try_cast(right(ltrim('0', p), 9) as int), 0) <= 255 and length(ltrim('0', p)) <= 3)",
         0.5, "ip|address|host|server|login|adresse"),
    Kind("card", "text rlike '[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]'",
         r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
         f"length({_digits('m')}) between 16 and 19 and luhn_check(case when length({_digits('m')}) <= 19 then {_digits('m')} else '1' end)",
         0.5, "card|karte|tarjeta|carte|visa|credit|payment"),
    Kind("phone", "contains(text, '+')", r"\+[0-9][\x20().0-9-]+[0-9]",
         f"length({_digits('m')}) between 8 and 15", 0.5, "phone|tel|call|mobile|telefon"),
    Kind("iban", "text rlike '[A-Z][A-Z][0-9][0-9] ?[A-Z0-9]'",
         rf"(?<![A-Za-z0-9])(?:{_IBAN})(?![A-Za-z0-9])", _MOD97, 0.5,
         "iban|konto|account|cuenta|compte|bank", False),
    Kind("short_card", "text rlike '[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]'",
         r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
         f"length({_digits('m')}) between 13 and 15 and luhn_check(case when length({_digits('m')}) <= 15 then {_digits('m')} else '1' end)",
         0.3, "card|karte|tarjeta|carte|visa|amex|credit", False),
    Kind("local_phone", r"text rlike '[0-9]{3}[-. ][0-9]{4}'", r"(?<![0-9+()-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9-])",
         "true", 0.3, "phone|tel|call|mobile|telefon", False),
)
BASE = tuple(k.name for k in KINDS if k.base)


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _found(kind: Kind) -> Column:
    return F.expr(f"case when {kind.hint} then regexp_extract_all(text, {_lit(kind.pattern)}, 0) end")


def _scored(kind: Kind) -> str:
    """SQL: an array of (gap before, length, kept, score) for the matches in f, whose surroundings are the pieces in g.

    The context is the text next to a span, earlier and later matches in it; only confirmed spans are scored.
    """
    near = CONTEXT // 2     # a match and the gap beside it: of these, 40 characters hold 20 at most
    before = (f"case when length(b) >= {CONTEXT} or i = 0 then right(b, {CONTEXT}) else right(concat(array_join(transform(sequence(greatest(i - {near}, 0), i - 1), "
              f"j -> concat(right(g[j], {CONTEXT}), right(f[j], {CONTEXT}))), ''), b), {CONTEXT}) end")
    after = (f"case when length(a) >= {CONTEXT} or i = size(f) - 1 then left(a, {CONTEXT}) else left(concat(a, array_join(transform("
             f"sequence(i + 1, least(i + {near}, size(f) - 1)), j -> concat(left(f[j], {CONTEXT}), left(g[j + 1], {CONTEXT}))), '')), {CONTEXT}) end")
    score = (f"case when v then {kind.prior} + case when lower(concat({before}, ' ', {after})) rlike "
             f"{_lit(f'(?<![a-z])(?:{kind.words})')} then 0.3 else 0.0 end else 0.0 end")
    kept = "v" if kind.base else f"v and s >= {MIN_SCORE}"
    body = f"named_struct('gap', length(b), 'len', length(m), 'kept', {kept}, 'score', s)"
    body = f"element_at(transform(array({kind.valid}), v -> element_at(transform(array({score}), s -> {body}), 1)), 1)"
    body = f"element_at(transform(array(f[i]), m -> element_at(transform(array(g[i]), b -> element_at(transform(array(g[i + 1]), a -> {body}), 1)), 1)), 1)"
    return f"transform(sequence(0, size(f) - 1), i -> {body})"


def _starts(kind: str) -> str:
    """SQL: kept spans of x (array of gap, len, kept, score) with absolute offsets, by running sums in two levels."""
    inner = (f"transform(sequence(0, (size(x) - 1) div {BLOCK}), k -> aggregate(slice(x, k * {BLOCK} + 1, {BLOCK}), "
             "named_struct('at', 0L, 'out', cast(array() as array<struct<s:bigint,e:bigint,kept:boolean,score:double>>)), "
             "(acc, y) -> named_struct('at', acc.at + y.gap + y.len, 'out', concat(acc.out, array(named_struct("
             "'s', acc.at + y.gap, 'e', acc.at + y.gap + y.len, 'kept', y.kept, 'score', cast(y.score as double)))))))")
    bases = ("aggregate(blocks, cast(array(0L) as array<bigint>), (acc, z) -> "
             "concat(acc, array(element_at(acc, -1) + z.at)))")
    spans = ("flatten(transform(blocks, (z, k) -> transform(filter(z.out, y -> y.kept), y -> "
             f"named_struct('kind', '{kind}', 's', bases[k] + y.s, 'e', bases[k] + y.e, 'score', y.score))))")
    return (f"element_at(transform(array({inner}), blocks -> element_at(transform(array({bases}), bases -> {spans}), 1)), 1)")


def find(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with a column ``spans``: array of (kind, s, e, score), by kind as listed in ``KINDS``, then start.

    Offsets are code points, e exclusive.
    """
    keep = [c for c in df.columns if c != "spans"]
    work = df.select(F.struct(*keep).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    none = "cast(array() as array<struct<kind:string,s:bigint,e:bigint,score:double>>)"
    work = work.select("_row", "text", *(_found(k).alias(f"f_{k.name}") for k in KINDS))
    spans = []
    for k in KINDS:
        x = f"element_at(transform(array(struct(f_{k.name} as f, split(text, {_lit(k.pattern)}, -1) as g)), q -> {_scored(k).replace('f[', 'q.f[').replace('g[', 'q.g[').replace('size(f)', 'size(q.f)')}), 1)"
        spans.append(f"case when size(f_{k.name}) > 0 then element_at(transform(array({x}), x -> {_starts(k.name)}), 1) else {none} end")
    return work.select("_row.*", F.expr(f"concat({', '.join(spans)})").alias("spans"))


def joined(kinds: tuple[str, ...] | None = None) -> str:
    """SQL: kind:start:end of the spans, comma-joined."""
    kept = "spans" if kinds is None else f"filter(spans, x -> x.kind in ({', '.join(map(repr, kinds))}))"
    return f"array_join(transform({kept}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"


def mask(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` whose text has each kept span replaced by its kind in angle brackets, kind after kind; null stays null."""
    for k in KINDS:
        x = f"element_at(transform(array(struct(f, split(text, {_lit(k.pattern)}, -1) as g)), q -> {_scored(k).replace('f[', 'q.f[').replace('g[', 'q.g[').replace('size(f)', 'size(q.f)')}), 1)"
        put = (f"concat(g[0], array_join(transform(x, (y, i) -> concat(case when y.kept then '<{k.name.upper()}>' else f[i] end, g[i + 1])), ''))")
        work = df.select(F.struct(*df.columns).alias("_row"), F.col(text).alias("text"))
        work = work.withColumn("f", F.expr(f"case when {k.hint} then regexp_extract_all(text, {_lit(k.pattern)}, 0) end"))
        work = work.withColumn("x", F.expr(f"case when size(f) > 0 then {x} end"))
        out = F.expr(f"case when exists(x, y -> y.kept) then element_at(transform(array(split(text, {_lit(k.pattern)}, -1)), g -> {put}), 1) else text end")
        df = work.select(*(out.alias(c) if c == text else F.col("_row")[c].alias(c) for c in df.columns))
    return df


def report(docs: DataFrame) -> DataFrame:
    """One row per document: base counts, the digest of base spans, and all spans."""
    found = find(docs.select("doc_id", "text"))
    count = [F.expr(f"size(filter(spans, x -> x.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *count, F.sha2(F.expr(joined(BASE)), 256).alias("base_sha256"), F.expr(joined()).alias("spans"),
                        F.expr(f"size(filter(spans, x -> x.kind not in ({', '.join(map(repr, BASE))})))").cast("long").alias("n_added"))

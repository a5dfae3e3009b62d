"""Checking SQL for DuckDB, by the definitions of the contracts and not by the methods of the operators."""
from __future__ import annotations

from tidebars.llm import secret_scan, spelling, vector_codes
from tidebars.llm.common import WORD

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def jaccard(k: int = 4, percent: int = 85) -> str:
    """All pairs of documents with a common shingle, and who is reachable from whom."""
    window = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, {_quoted(WORD)}) AS w FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {k - 2}), lambda i: {window}) END) AS s FROM texts
), sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS MATERIALIZED (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN sizes m ON m.doc_id = a JOIN sizes n ON n.doc_id = b
  WHERE 100 * common >= {percent} * (m.n + n.n - common)
), reach AS (
  SELECT a, b FROM links
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) r USING (doc_id)"""


def secrets() -> str:
    """Every rule over every text; offsets are sums of what lies before."""
    def spans(i: int, rule: secret_scan.Rule) -> str:
        pattern = rule.pattern.replace("*+", "*").replace("++", "+").replace("}+", "}").replace("(?<![0-9a-f])", "").replace(
            "(", "(?:").replace("(?:?", "(?")
        tested = "m[i]"
        if rule.group:      # the group is the last thing of the pattern
            tested = f"regexp_extract(m[i], {_quoted(rule.pattern.rsplit('(', 1)[1].rstrip(')').replace('++', '+') + '$')})"
        return f"""
  SELECT doc_id, {i} AS k, '{rule.name}' AS kind, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: {{
      's': list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0),
      'n': len(m[i]), 'tested': len({tested})}}), lambda x: x.tested >= {rule.least})) AS x
  FROM (SELECT doc_id, regexp_extract_all(text, {_quoted(pattern)}) AS m, string_split_regex(text, {_quoted(pattern)}) AS g FROM documents)"""

    found = " UNION ALL ".join(spans(i, r) for i, r in enumerate(secret_scan.RULES))
    base = ", ".join(map(_quoted, secret_scan.BASE))
    text = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k)"
    return f"""
WITH found AS ({found}
), spans AS (SELECT doc_id, k, kind, x.s::BIGINT AS s, (x.s + x.n)::BIGINT AS e FROM found
), per AS (
  SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{b}') AS n_{b}" for b in secret_scan.BASE)},
    {text} FILTER (kind IN ({base})) AS base, {text} AS spans FROM spans GROUP BY doc_id
)
SELECT d.doc_id, {', '.join(f'coalesce(n_{b}, 0) AS n_{b}' for b in secret_scan.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN per USING (doc_id)"""


def codes(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS, scale: int = vector_codes.SCALE) -> str:
    """Every part against every entry in every round."""
    far = "list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - b.x[i]) * (v.x[i] - b.x[i])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS MATERIALIZED (
  SELECT vec_id, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT v.vec_id, v.p, b.e, {far}::BIGINT AS d FROM parts v JOIN book{r} b ON b.p = v.p) GROUP BY vec_id, p)""")
        if r < rounds:
            steps.append(f"""book{r + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN (
    SELECT p, e, list(floor(s / n)::BIGINT ORDER BY i) AS x FROM (
      SELECT p, e, i, sum(c)::DOUBLE AS s, count(*) AS n FROM (
        SELECT n.p, n.e, unnest(range(len(v.x))) AS i, unnest(v.x) AS c FROM near{r} n JOIN parts v USING (vec_id, p)) GROUP BY p, e, i) GROUP BY p, e) m
  ON m.p = b.p AND m.e = b.e)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda v: floor({scale} * v::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, p, x[p * len(x) // {parts} + 1:(p + 1) * len(x) // {parts}] AS x FROM kept, range({parts}) t(p)
), book0 AS (
  SELECT p, e, x FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept) USING (vec_id) WHERE e < {entries}
), {', '.join(steps)}, coded AS (
  SELECT k.vec_id, k.label, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
  FROM near{rounds} JOIN kept k USING (vec_id) GROUP BY k.vec_id, k.label
), books AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, books"""


def _crc_table() -> list[int]:
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def words() -> str:
    """Every word against every other of about its length. The comparison counts bytes, so each letter becomes one."""
    latin = "".join(map(chr, range(0xC0, 0x100)))
    stand_ins = "".join(chr(c) for c in range(33, 127) if not chr(c).islower() and chr(c) != "'")[:64]
    run = f"CASE WHEN h % {spelling.SLIP} = 0 THEN left(low, (h % len(low))::INT) || substr(low, (h % len(low))::INT + 2) ELSE low END"
    table = "[" + ", ".join(f"{x}::UINTEGER" for x in _crc_table()) + "]"
    return f"""
WITH RECURSIVE tokens AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, {LOWER.format('r')} AS low, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, {_quoted(spelling.RUN)})) AS r FROM documents) GROUP BY ALL
), bytes AS (
  SELECT low, n, hex(encode(doc || ':' || low)) AS h FROM tokens
), hashed AS (
  SELECT low, n, xor(list_reduce(list_prepend(4294967295::UINTEGER, list_transform(range(len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::UINTEGER)),
    lambda crc, b: xor(crc >> 8, t.t[(xor(crc, b) & 255) + 1])), 4294967295::UINTEGER)::BIGINT AS h FROM bytes, (SELECT {table} AS t) t
), vocabulary AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n, translate(word, '{latin}', '{stand_ins}') AS plain
  FROM (SELECT {run} AS word, n FROM hashed) WHERE len(word) >= {spelling.LEAST} GROUP BY word HAVING sum(n) >= {spelling.OFTEN}
), near AS MATERIALIZED (
  SELECT a.word, b.word AS near, b.n AS m FROM vocabulary a JOIN vocabulary b
    ON len(b.word) BETWEEN len(a.word) - 1 AND len(a.word) + 1 AND levenshtein(a.plain, b.plain) = 1
), formed AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(c.n_near, 0) AS n_near, CASE WHEN c.m >= {spelling.OFTEN} * v.n THEN c.near END AS form,
    CASE WHEN c.m >= {spelling.OFTEN} * v.n THEN c.m END AS form_n
  FROM vocabulary v LEFT JOIN (SELECT word, count(*) AS n_near, first(near ORDER BY m DESC, near) AS near, max(m) AS m FROM near GROUP BY word) c USING (word)
), chain AS (
  SELECT word, word AS at FROM formed
  UNION ALL
  SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c USING (word) JOIN formed e ON e.word = c.at WHERE e.form IS NULL"""

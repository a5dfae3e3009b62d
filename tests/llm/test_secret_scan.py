"""Secrets against plain regular expressions, and what the ledger reads."""
import dataclasses
import hashlib
import random
import re

from pyspark.sql import functions as F

from tidebars.llm import secret_scan as s
from tidebars.session import stage_path

from .conftest import odd_rows

PLAIN = (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
         ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24))


def base(text):
    found = [(m.start(), i, name, m.end()) for i, (name, p, group, least) in enumerate(PLAIN) for m in p.finditer(text or "")
             if len(m.group(group)) >= least]
    return [(name, a, b) for a, _, name, b in sorted(found)]


def check(got, texts):
    assert len(got) == len(texts)
    want = []
    for doc, text in texts:
        spans = base(text)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.append((str(doc), *(sum(k == name for k, *_ in spans) for name in s.BASE), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == sorted(want)


def texts(n, seed=3):
    rng = random.Random(seed)
    parts = ["password", "Token", "SECRET", "api_key", "apikey", "passwd", "=", ":", " ", "  ", '"', "'", "abc", "abcdef0123456789", "AKIA", "AKIAAKIA",
             "ABCDEFGH12345678", "ä😀", "\n", "token:token:abcdefg", "ſecret=abcdefgh", "toKen=abcdefgh", "0" * 30, "deadbeef" * 3, "x=y", "."]
    return [(i, "".join(rng.choices(parts, k=rng.randint(0, 30)))) for i in range(n)]


def test_base_spans(spark):
    rows = texts(1500)
    check(s.report(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)


def test_odd_rows(spark, odd, none):
    got = s.report(odd).collect()
    check(got, [(r[0], r[1]) for r in odd_rows()])
    assert s.report(none).collect() == []


ADDED = [
    ("key ghp_" + "a1B2" * 9 + " end", "github", (4, 44)),
    ("xoxb-123456789012-abcdef", "slack", (0, 24)),
    ("ä AIza" + "x" * 35 + ".", "google", (2, 41)),
    ("eyJhbGciOiJI.eyJzdWIiOiIx.sig-x", "jwt", (0, 31)),
    ("see https://me:hunter2@host/x", "url_password", (9, 23)),
    ("Authorization: Bearer " + "q" * 24, "bearer", (15, 46)),
    ("-----BEGIN RSA PRIVATE KEY-----\nMIIB\n-----END RSA PRIVATE KEY-----", "private_key", (0, 66)),
]


def test_added_kinds(spark):
    got = s.report(spark.createDataFrame([(i, a[0]) for i, a in enumerate(ADDED)], "doc_id long, text string")).collect()
    for r in got:
        _, kind, span = ADDED[r.doc_id]
        assert f"{kind}:{span[0]}:{span[1]}" in r.spans.split(",")


def versions(spark, rows):
    return spark.createDataFrame(rows, "path string, version int, text string")


def scanned(spark, ledger):
    return [(r.rule, bytes(r.blob)) for r in spark.read.schema(s.SCANNED).parquet(f"{ledger}/scanned").select("blob", F.explode("rules").alias("rule")).collect()]


def test_only_unseen_pairs_are_scanned_and_all_paths_report(spark):
    ledger = stage_path(spark, "test_ledger")
    s.start(spark, ledger)
    a, b, c = "token = abcdefgh", "nothing", "password: 12345678"
    first = [("x", 1, a), ("y", 1, a), ("z", 1, b)]
    s.update(versions(spark, first), ledger)
    one = scanned(spark, ledger)
    assert len(one) == len(set(one)) == 2 * len(s.RULES)
    # later versions: a known blob comes back under a new path, one is new
    every = [*first, ("x", 2, c), ("w", 2, a)]
    addressed = s.update(versions(spark, every), ledger)
    two = scanned(spark, ledger)
    assert len(two) == len(set(two)) == 3 * len(s.RULES)
    got = {(r.path, r.version): [tuple(x) for x in r.spans] for r in s.findings(addressed, ledger).collect()}
    hit, other = [("assign", 0, 16)], [("assign", 0, 18)]
    assert got == {("x", 1): hit, ("y", 1): hit, ("z", 1): [], ("x", 2): other, ("w", 2): hit}
    # one changed rule reads every blob again, the others none
    rules = [dataclasses.replace(r, version=2, pattern="noth") if r.name == "hex" else r for r in s.RULES]
    s.update(versions(spark, every), ledger, rules)
    three = scanned(spark, ledger)
    assert len(three) == len(two) + 3 and {r for r, _ in three} - {r for r, _ in two} == {"hex@2"}
    got = {(r.path, r.version): [tuple(x) for x in r.spans] for r in s.findings(addressed, ledger, rules).collect()}
    assert got["z", 1] == [("hex", 0, 4)] and got["x", 1] == hit
    # what is known is scanned again after a loss of the last step and counts once
    again = stage_path(spark, "test_ledger")
    s.start(spark, again)
    spark.read.parquet(f"{ledger}/findings").write.mode("append").parquet(f"{again}/findings")
    addressed = s.update(versions(spark, every), again, rules)
    assert {(r.path, r.version): len(r.spans) for r in s.findings(addressed, again, rules).collect()} == {k: len(v) for k, v in got.items()}


def test_long_text(spark):
    text = "token = abcdef " * 20000 + "a1" * 500000
    rows = [(1, text), (2, "secret" * 100000), (3, "password" + " " * 300000)]
    check(s.report(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows)

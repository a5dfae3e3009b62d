import hashlib
import re

from tidebars.llm import pii

from .conftest import odd_rows


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text):
    """The base rules in plain Python."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


TEXTS = [
    "a@b.com_x@y.org", "x@y@z.com", "1.2.3.4.5.6.7.8", "999.1.1.1 1.2.3.04", "+1 (017) 555-7713 +12", "4111 1111-1111 1111",
    "é 😀 a@b.co 😀 +4912345678", "1 2 3 4 5 6" * 300, "a@b.c " * 300, "0000000000000000", "1.2.3." + "9" * 50, "mail .34@mail7.example.com ok",
    "9807915762804490 7536784127813050", "+1" + "(" * 500, "a" * 3000 + "@", "+1.2.3.4.5.6.7.8.9 1.1.1.1", "..@a.b %@-.- @x.y",
]


def test_base_spans_equal_plain_rules(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in pii.report(df).collect():
        want = base_spans(TEXTS[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), TEXTS[r.doc_id][:60]
        assert r.spans.startswith(joined)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in ("email", "ip", "card", "phone")]


def test_checksums_and_context_decide_added_spans(spark):
    rows = [(1, "iban DE89 3704 0044 0532 0130 00 x"), (2, "iban DE88 3704 0044 0532 0130 00 x"), (3, "call 555-123-4567"), (4, "part 555-123-4567"),
            (5, "amex card 378282246310005"), (6, "number 378282246310005"), (7, "card 378282246310006")]
    found = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: "iban:5:32", 2: "", 3: "local_phone:5:17", 4: "", 5: "short_card:10:25", 6: "", 7: ""}


def test_iban_ends_where_its_country_says(spark):
    rows = [(1, "DE89370400440532013000 Please pay"), (2, "iban DE89370400440532013000 I"), (3, "to DE89 3704 0044 0532 0130 00 NOW bank"),
            (4, "konto NO9386011117947, GB82 WEST 1234 5698 7654 32 A1"), (5, "iban DE8937040044053201300 0X"), (6, "bank MT84MALT011000012345MTLCAST001S 7")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.report(df).collect()}
    assert found == {1: "iban:0:22", 2: "iban:5:27", 3: "iban:3:30", 4: "iban:6:21,iban:23:50", 5: "", 6: "iban:5:36"}
    assert {r.doc_id: r.text for r in pii.mask(df).collect()}[1] == "<IBAN> Please pay"


def test_context_reaches_over_other_matches(spark):
    rows = [(1, "Phone: 555-123-4567, 555-234-5678"), (2, "555-123-4567, 555-234-5678 by phone"), (3, "card 378282246310005, 378282246310005"),
            (4, "phone" + " x" * 25 + " 555-123-4567, 555-234-5678"), (5, "Phone: 1 2, 3; 555-123-4567, 12 555-234-5678" + " y" * 20 + " 555-234-5678")]
    found = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: "local_phone:7:19,local_phone:21:33", 2: "local_phone:0:12,local_phone:14:26", 3: "short_card:5:20,short_card:22:37",
                     4: "", 5: "local_phone:15:27,local_phone:32:44"}


def test_mask_replaces_every_span(spark):
    rows = [(1, "to a@b.co or +49 123 456789, 10.0.0.1; iban GB82WEST12345698765432."), (2, None), (3, "clean 12 text")]
    got = [r.text for r in pii.mask(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["to <EMAIL> or <PHONE>, <IP>; iban <IBAN>.", None, "clean 12 text"]


def test_odd_and_empty_tables(spark, odd, none):
    assert pii.report(odd).count() == len(odd_rows())
    assert pii.mask(odd).columns == odd.columns and pii.mask(odd).count() == len(odd_rows())
    assert pii.report(none).count() == 0

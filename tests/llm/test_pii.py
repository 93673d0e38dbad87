import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from spanloom.llm import pii
from spanloom.llm.queries import op8_pii  # noqa: F401

RX = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def brute(t):
    out = [(m.start(), i, k, m.end()) for i, (k, rx) in enumerate(RX.items()) for m in re.finditer(rx, t or "") if ok(k, m[0])]
    return [(s, k, e) for s, _, k, e in sorted(out)]


def found(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = sorted(pii.find(df).collect(), key=lambda r: r["doc_id"])
    return [[(s["start"], s["kind"], s["end"]) for s in r["pii"] if s["kind"] in RX] for r in rows]


CASES = [
    None, "", "mail a.b+c@mail3.example.com, a@b@c.d.e. x@y", "a@b.c_d@e.f a@b.c%x@q.r", "1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.255 0000000.0.0.0",
    "4041 8949 7460 8795 and 4041894974608795 1234567890123456", "+1 (988) 555-2485 orthen +44 20 7946 0958. +12", "12--34 5 6 7  8", "😀é a@b.co ü 10.0.0.1",
    "7" * 30_000, "1." * 20_000, "a" * 30_000, "a@" * 10_000, "+1" + " " * 20_000 + "2", "4 " * 20_000, "x@" + "a." * 15_000,
]


def test_cases_of_all_kinds_and_lengths(spark):
    assert found(spark, CASES) == [brute(t) for t in CASES]


def test_random_texts(spark):
    texts = []

    @given(st.text(alphabet="a.@0159+-( )_%é", max_size=40))
    @settings(max_examples=400, deadline=None, database=None)
    def collect(t):
        texts.append(t)

    collect()
    assert found(spark, texts) == [brute(t) for t in texts]


def test_checksums(spark):
    got = spark.range(1).select(
        pii.luhn(F.lit("4111111111111111")), pii.luhn(F.lit("4111111111111112")), pii.mod97(F.lit("GB82 WEST 1234 5698 7654 32")), pii.mod97(F.lit("GB82WEST12345698765433"))
    ).first()
    assert tuple(got) == (True, False, True, False)


def test_context_and_added_kinds(spark):
    df = spark.createDataFrame([("pay to IBAN GB82 WEST 1234 5698 7654 32 now",), ("ssn 123-45-6789",), ("part 123-45-6789",), ("call my phone: +1 (988) 555-2485",)], "text string")
    rows = [r["pii"] for r in pii.find(df).collect()]
    assert [(s["kind"], s["text"], round(s["score"], 2)) for s in rows[0]] == [("iban", "GB82 WEST 1234 5698 7654 32", 1.0)]
    assert [s["kind"] for s in rows[1]] == ["ssn"] and rows[2] == []
    assert rows[3][0]["score"] == 1.0


def test_redaction(spark):
    df = spark.createDataFrame([(1, "to a@b.co or +1 (988) 555-2485, ip 10.0.0.1!", "x"), (2, "none", "y"), (3, None, "z"), (4, "4111111111111111", "w")], "doc_id long, text string, pii string")
    out = pii.redact(df)
    assert out.columns == df.columns
    assert [r["text"] for r in out.orderBy("doc_id").collect()] == ["to [EMAIL] or [PHONE], ip [IP]!", "none", None, "[CARD]"]
    assert pii.redact(df.limit(0)).collect() == []


def test_empty_and_repeated_rows_and_context(spark):
    rows = [(1, "my ssn 123-45-6789, other 123-45-6789 " + "x" * 60 + " 123-45-6789"), (1, "my ssn 123-45-6789, other 123-45-6789 " + "x" * 60 + " 123-45-6789"), (2, None), (None, "")]
    df = spark.createDataFrame([(k, t, "old") for k, t in rows], "doc_id long, text string, pii string")
    found = pii.find(df)
    assert found.columns == df.columns and pii.find(df.limit(0)).collect() == [] == pii.redact(df.limit(0)).collect()
    got = [[(s["kind"], s["start"], round(s["score"], 2)) for s in r["pii"]] for r in found.collect()]
    assert got == [[("ssn", 7, 0.65), ("ssn", 26, 0.65)]] * 2 + [[], []]
    out = pii.redact(df)
    assert out.columns == df.columns and [r["text"] for r in out.collect()][1:] == ["my ssn [SSN], other [SSN] " + "x" * 60 + " 123-45-6789", None, ""]


def test_work_grows_with_a_texts_length(spark):
    import time

    took = []
    for n in (2000, 20_000, 40_000):
        d = spark.createDataFrame([("mail a.b@c.example.org or 10.0.0.1 now, " * n,)], "text string").cache()
        d.count()
        began = time.perf_counter()
        assert len(pii.redact(d).first()["text"]) == n * len("mail [EMAIL] or [IP] now, ")
        took.append(time.perf_counter() - began)
    assert took[2] < 2.6 * took[1] + 1

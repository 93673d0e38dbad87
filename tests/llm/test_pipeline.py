import random
import re

import numpy as np
from conftest import DATA
from test_bpe import expected
from test_line_dedup import brute as lines_brute
from test_ngram_join import brute as near_brute
from test_pii import brute as pii_brute

import corpus_pipeline
from spanloom.llm import wordbpe
from spanloom.llm.shared import written


def test_stages_against_brute_force(spark):
    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(100_001, "12 !? 34", "en", "src0", 8), (100_002, None, None, None, None), (100_003, "A plain text of some words, with a@b.example.com in it.", "en", None, 55)], docs.schema)
    docs = docs.unionByName(odd)
    names, outs = [n for n, _ in corpus_pipeline.STAGES], {}
    cur = docs
    for name, stage in corpus_pipeline.STAGES:
        before = cur
        cur = written(stage(spark, cur, sf), f"test-{name}")
        outs[name] = (before, cur)
    text = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    a, b = map(text, outs["language"])
    assert set(a) - set(b) == {100_001, 100_002} and all(b[k] == a[k] for k in b)
    a, b = map(text, outs["lines"])
    assert b == {i: t for i, t, _, _ in lines_brute(list(a.items()), 10)}
    a, b = map(text, outs["near_copies"])
    classes = {k: least for _, k, least, _ in near_brute(list(a.items()))}
    assert set(b) == {k for k in a if classes[k] == k} and all(b[k] == a[k] for k in b)
    a, b = map(text, outs["personal_data"])
    for k, t in a.items():
        assert (b[k] == t) == (not pii_brute(t)) or "IBAN" in b[k]
        assert not pii_brute(b[k])
    assert "[EMAIL]" in b[100_003]
    assert all(r["n_chars"] == len(r["text"]) for r in outs["personal_data"][1].collect())
    for n in names[:-1]:
        assert outs[n][1].columns == docs.columns
    spec, parts = wordbpe.spec_of(), {}
    for r in outs["pack"][1].collect():
        parts.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    assert {k: sum((p for _, p in sorted(v)), []) for k, v in parts.items()} == {k: [*expected(spec, t), 2] for k, t in b.items()}
    assert not any(re.search(r"@mail\d", t) for t in b.values())


def test_language_rejects_what_is_in_no_language(spark):
    sf, r = f"{DATA}/sf0.01", random.Random(1)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    letters = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9)))
    junk = [" ".join(letters() for _ in range(500)) for _ in range(10)] + [r.randbytes(1500).hex() for _ in range(10)]
    odd = spark.createDataFrame([(200_000 + i, t, None, "src0", len(t)) for i, t in enumerate(junk)], docs.schema)
    kept = {x["doc_id"] for x in corpus_pipeline.language(spark, docs.unionByName(odd), sf).select("doc_id").collect()}
    assert not any(200_000 + i in kept for i in range(20))
    assert len(kept) >= 0.995 * docs.filter("text rlike '[a-zA-Z]'").count()


def test_run_reads_documents(spark):
    out = corpus_pipeline.run(spark, f"{DATA}/sf0.001")
    assert {"doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns) and out.count() > 100
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_empty_repeated_and_clashing_input(spark):
    """All stages on an empty table; on repeated rows, null ids and texts, and columns named like the operators' own."""
    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cur = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        cur = written(stage(spark, cur, sf), f"empty-{name}")
        assert cur.collect() == [] and (name == "pack" or cur.columns == docs.columns)
    clash = {"key": "1", "node": "'n'", "row": "2", "id": "3", "at": "'a'", "label": "'l'", "__pii_spans": "4", "gone": "'g'", "lines": "5", "pos": "6", "h": "7", "ids": "'i'", "one": "8"}
    some = docs.filter("lang IS NOT NULL").orderBy("doc_id").limit(80)
    odd = spark.createDataFrame([(None, "a row without an id in plain words that are its own", "en", None, None), (5_000, None, "en", "s", 1), (5_001, "", None, None, 0)], docs.schema)
    cur = some.unionByName(some.limit(20)).unionByName(odd).selectExpr("*", *[f"{v} AS {k}" for k, v in clash.items()])
    columns, seen = cur.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        cur = written(stage(spark, cur, sf), f"clash-{name}")
        assert cur.columns == columns and cur.select(*clash).distinct().count() == 1, name
        seen.append(cur.count())
        if name == "near_copies":  # repeated rows are copies of each other
            assert cur.filter("text rlike '[a-z]'").groupBy("text").count().filter("count > 1").count() == 0
    assert seen[0] <= seen[1] == seen[0] and seen[2] < seen[1] and seen[3] == seen[2]
    assert corpus_pipeline.pack(spark, cur, sf).agg({"length": "sum"}).first()[0] > seen[3]

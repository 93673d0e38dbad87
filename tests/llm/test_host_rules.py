import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from test_textbuf import twins

from conftest import DATA
from spanloom.llm import oracles
from spanloom.llm.host_rules import COUNTS, count_slice, judge, prior
from spanloom.llm.textbuf import slices


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    win = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {i + j for i in range(len(w) - 4) if win[tuple(w[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(cover), "n_lines": len(lines)}


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab #\n\t|é😀", max_size=60)), max_size=6))
@settings(max_examples=200, deadline=None)
def test_counts(texts):
    got = []
    for lo, hi, buf, offs in slices(pa.array(texts, pa.string()), 40):
        c = count_slice(buf, offs)
        got += [{k: int(c[k][i]) for k in COUNTS} for i in range(hi - lo)]
    assert got == [brute(t) for t in texts]


@pytest.mark.parametrize("n", [1024, 4096])
def test_lines_and_words_that_polynomial_hashes_confuse(n):
    a, b = twins(n)
    for text in (f"{a}\n{b}\n{a}", f"{a}\n{b}", f"one two three four {a} one two three four {b}", f"one two three four {a} one two three four {a}"):
        buf = np.frombuffer(text.encode(), np.uint8)
        got = count_slice(buf, np.array([0, len(buf)]))
        assert {k: int(v[0]) for k, v in got.items()} == brute(text)


def test_verdicts(spark):
    r = random.Random(1)
    good = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(40))
    bad = "spam spam spam spam spam spam " * 10
    rows = [(i, good(), f"h{i % 9}", 0) for i in range(300)]
    rows += [(1000 + i, bad, "junk", 0) for i in range(200)] + [(1300, good(), "junk", 0), (1301, bad, "h1", 0), (1302, None, "h1", 0), (1303, "", None, 0), (1304, good(), None, 0), (None, good(), "h2", 0), (1305, bad, "tiny", 0), (1306, good(), "tiny", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int")
    got = {x["doc_id"]: x for x in judge(df).collect()}
    assert len(got) == len(rows)
    for i, t, _, _ in rows:
        b = brute(t)
        assert {k: got[i][k] for k in COUNTS} == b
        assert got[i]["base_failed"] == (b["n_words"] < 10 or 100 * b["n_repeat_words"] > 20 * b["n_words"])
    assert all(got[i]["kept"] for i in range(300)) and got[1304]["kept"] and got[None]["kept"]
    assert not got[1300]["kept"] and not got[1300]["base_failed"]  # the host's verdict
    assert got[1306]["kept"]  # two documents say little of a host
    assert not got[1301]["kept"] and not got[1303]["kept"]
    assert judge(df.limit(0)).collect() == []
    assert all(x["kept"] is False for x in judge(df.filter("doc_id = 1303")).collect())


def test_sql_on_planted_hosts(spark, tmp_path):
    """A host of many bad documents is refused, one of two bad documents is saved by shrinkage, in the query as in its SQL."""
    import duckdb

    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    good, bad = "some plain words that stand here one after the other and differ", "!! $$ ## " * 30
    more = [(10_000 + i, (bad if i % 10 else good) + f" {i}", "en", "bad host", 0) for i in range(60)]
    more += [(20_000 + i, bad, "en", "two documents", 0) for i in range(1)] + [(20_010, good, "en", "two documents", 0)]
    more += [(30_000 + i, bad if i % 5 == 0 else good, "en", "mixed host", 0) for i in range(40)] + [(40_000, None, None, None, None)]
    all_ = docs.unionByName(spark.createDataFrame(more, docs.schema))
    all_.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r.asDict() for r in judge(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    rel = c.sql(oracles.OP7)
    assert {r[0]: dict(zip(rel.columns, r)) for r in rel.fetchall()} == got
    assert not got[10_000]["base_failed"] and not got[10_000]["kept"]
    assert got[20_010]["kept"] and got[30_001]["kept"]


def test_prior_follows_the_moments():
    rng = np.random.default_rng(0)
    rates = rng.beta(2, 6, 4000)
    n = 200
    seen = rng.binomial(n, rates) / n
    a, b = prior(len(seen), seen.mean(), (seen**2).mean(), 1 / n)
    assert abs(a - 2) < 0.4 and abs(b - 6) < 1.2
    assert sum(prior(5, 0.1, 0.01, 0.1)) == 1e6 and sum(prior(1, 0.5, 0.25, 1.0)) == 1.0
    assert 0 < prior(3, 0.0, 0.0, 0.1)[0]

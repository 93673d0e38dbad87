import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from test_textbuf import twins

from spanloom.llm import chunk_bpe, packing, wordbpe

ODD = [
    "", None, "a<|endoftext|>b <|startoftext|>", "don't they'll 'sx !'s x'S", "J̌ É ́a ≠ a", "“,” é, ,é 1234 a1b2 ١٢",
    "x" * 3000 + " " + "é!" * 2000, "\x85a\x85", "é'll rock'n'roll 's's" * 300, "a b " * 2000, "a1!" * 3000, " " * 3000 + "x",
    "\n".join(f"q{i} zz" for i in range(2000)), "ab' s'" * 500, "\x00\x1c!\x1c", "ǅ İİ ΑΣ ﬁ", "same words here " * 400,
]


@pytest.fixture(scope="module")
def spec():
    return wordbpe.spec_of()


def expected(spec, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec).encode(text or "", add_special_tokens=False).ids


def rows(encoder, texts):
    out = []
    for lo, hi, ids, at in encoder.encode(pa.array(texts, pa.string())):
        out += [ids[at[i] : at[i + 1]].tolist() for i in range(hi - lo)]
    return out


def test_words_equal_the_library(spec):
    assert rows(wordbpe.WordBpe(spec), ODD * 2) == [expected(spec, t) for t in ODD] * 2


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_polynomial_hashes_confuse(spec, n):
    a, b = twins(n)
    texts = [f"{a} {b}", f"{b} {a} {a[:60]} {b[:60]}", f"{a.upper()} {b}é {a}é", f"{b} x {a}"]
    assert rows(wordbpe.WordBpe(spec), texts) == [expected(spec, t) for t in texts] == rows(chunk_bpe.ChunkBpe(spec), texts)


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        wordbpe.spec_of(public_tokenizers.path("byte_bpe_50k.json"))


def test_a_special_tokens_string_leaves_other_rows_to_the_method(spec):
    c = chunk_bpe.ChunkBpe(spec, 64)
    texts = ["plain words " * 200, "a<|endoftext|>", "other plain words " * 200, "a<|endof", "text|>"]
    assert rows(c, texts) == [expected(spec, t) for t in texts] and c.asked == 4


def test_a_full_table_starts_anew(spec):
    w = wordbpe.WordBpe(spec, kept=50)
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(20)]
    assert rows(w, texts) == [expected(spec, t) for t in texts] and w.table.n <= 60


@pytest.mark.parametrize("mean", [64, 1024])
def test_chunks_equal_the_library_and_are_reused(spec, mean):
    c = chunk_bpe.ChunkBpe(spec, mean)
    assert rows(c, ODD) == [expected(spec, t) for t in ODD]
    made = c.made
    assert rows(c, ODD) == [expected(spec, t) for t in ODD] and c.made == made


def test_shared_passages_share_chunks_wherever_they_stand(spec):
    r = np.random.default_rng(1)
    passage = " ".join("".join(r.choice(list("abcdefgh"), 5)) for _ in range(800))
    c = chunk_bpe.ChunkBpe(spec, 256)
    rows(c, [passage])
    made = c.made
    rows(c, ["other start, then " + passage])
    assert c.made - made <= 3


def test_a_small_table_forgets_but_stays_right(spec):
    c = chunk_bpe.ChunkBpe(spec, 64, kept=20_000)
    assert rows(c, ODD) == [expected(spec, t) for t in ODD] and c.size <= 20_000


def test_joins_grow_until_the_outer_words_agree(spec):
    c = chunk_bpe.ChunkBpe(spec, 64)
    left, right = c.chunks([b"one two three four fi", b"ve six seven eight nine ten"])
    left.before = left.before.copy()
    left.ids = left.ids.copy()
    left.ids[left.before[3]] += 1  # as if the chunk alone had got another id for its last whole word
    (keep,), (drop,), (mid,) = c.joins([left], [right])
    assert c.grown and [*left.ids[:keep], *mid, *right.ids[drop:]] == expected(spec, "one two three four five six seven eight nine ten")


@given(st.text(alphabet="ab '!1é\n<|>", max_size=80))
@settings(max_examples=150, deadline=None)
def test_any_text(text):
    spec = wordbpe.spec_of()
    assert rows(wordbpe.tokenizer(spec), [text]) == [expected(spec, text)]


def test_encode_decode_and_digests(spark, spec):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_str(spec)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(None, "null id", "y"), (3, ODD[3], "x")], "doc_id long, text string, ids string")
    coded = chunk_bpe.encode(df)
    got = {(r["doc_id"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tobytes()) for r in coded.collect()}
    want = {(i, len(e), np.array(e, "<u4").tobytes()) for i, t in [*enumerate(ODD), (None, "null id")] for e in [expected(spec, t)]}
    assert got == want and coded.count() == len(ODD) + 2
    back = {r["doc_id"]: r["decoded"] for r in chunk_bpe.decode(coded).collect()}
    dig = {r["doc_id"]: r for r in chunk_bpe.digests(df).collect()}
    for i, t in enumerate(ODD):
        e = expected(spec, t)
        text = lib.decode(e, skip_special_tokens=False)
        assert back[i] == text
        assert dig[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest()
        assert dig[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert chunk_bpe.digests(df.limit(0)).collect() == []


@pytest.mark.parametrize("window", [4, 64, 4096])
def test_packing_is_one_gapless_sequence(spark, spec, window):
    texts = [*ODD[:6], "a b c d e f g h i j k l m", *ODD[8:9]]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(2, texts[2], 1), (None, "x", 1)], "doc_id long, text string, ids int").repartition(3)
    pieces = sorted(packing.pack(df, window=window).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    at, whole, n = 0, {}, {}
    for r in pieces:
        assert r["sequence_id"] * window + r["offset"] == at and 0 < r["length"] <= window - r["offset"]
        at += r["length"]
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"]
        whole.setdefault(r["doc_id"], []).append((r["start"], ids))
        n[r["doc_id"]] = r["doc_tokens"]
    for k, t in [*enumerate(texts), (None, "x")]:
        e = [*expected(spec, t), 2]
        assert n[k] == len(e)
        parts = [p for _, p in sorted(whole[k], key=lambda x: x[0])]
        assert sorted(sum(parts, [])) == sorted(e * (2 if k == 2 else 1))
        if k != 2:
            assert sum(parts, []) == e
    assert packing.pack(df.limit(0)).collect() == []

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from spanloom.llm import langid, quality_mil
from spanloom.llm.queries import fold, op2_quality_mil, op4_langid
from spanloom.llm.textbuf import slices


def numeric(model, key, at, loss, step=1e-2):
    w = model.w[key]
    old = w[at]
    w[at] = old + step
    up = loss()
    w[at] = old - step
    down = loss()
    w[at] = old
    return (up - down) / (2 * step)


def test_gru_gradients():
    m = langid.BiGru(["a", "b", "c"], hidden=4)
    r = np.random.default_rng(0)
    ids = r.integers(97, 102, (7, 5)).astype(np.uint8)
    label, weight = r.integers(0, 3, 5), (r.random((7, 5)) < 0.8).astype(np.float32)
    _, g = m.gradients(ids, label, weight)
    for key, at in (("xf", (2, 98)), ("xf", (9, 99)), ("xb", (5, 97)), ("uf", (1, 2)), ("uf", (10, 3)), ("ub", (6, 0)), ("o", (1, 5)), ("c", (2, 0))):
        assert abs(numeric(m, key, at, lambda: m.gradients(ids, label, weight)[0]) - g[key][at]) < 2e-3


def test_mil_gradients():
    m = quality_mil.AttentionMil(hidden=5, attention=3)
    r = np.random.default_rng(1)
    x = r.normal(0, 1, (9, quality_mil.N_FEATURES)).astype(np.float32)
    bag, y = np.array([0, 4, 5, 9]), np.array([1, 0, 1], np.float32)
    _, g = m.gradients(x, bag, y)
    for key, at in (("e", (3, 1)), ("eb", (2,)), ("v", (1, 2)), ("u", (4, 0)), ("a", (1,)), ("c", (3,)), ("b", (0,))):
        assert abs(numeric(m, key, at, lambda: m.gradients(x, bag, y)[0]) - g[key][at]) < 2e-3
    _, weight = m.attend(x, bag)
    assert np.allclose(np.add.reduceat(weight, bag[:-1]), 1)


def test_every_letter_of_a_long_text_counts():
    pairs = [("x", "ab " * 40)] * 30 + [("y", "qz " * 40)] * 30
    m = langid.train(pairs, rounds=60, hidden=4)
    text = "ab " * 30 + "qz " * 400
    buf = np.frombuffer(text.encode(), np.uint8)
    p = langid.document_scores(m, buf, np.array([0, 90, len(buf)]), 64)
    assert p[0].argmax() == 0 and p[1].argmax() == 1 and np.allclose(p.sum(axis=1), 1)


@pytest.fixture(scope="module")
def model():
    return langid.train([("x", "ab ba " * 30)] * 20 + [("y", "qz zq " * 30)] * 20, rounds=60, hidden=4)


ROWS = [(1, "ab ba ab"), (2, "qz zq"), (3, None), (4, ""), (5, "123 !?"), (6, "…«»€"), (7, "漢字"), (None, "ab ab"), (1, "ab ba ab"), (8, "ab " * 30_000)]


def test_language_of_odd_rows(spark, model):
    df = spark.createDataFrame([(k, t, "l", 0.5) for k, t in ROWS], "doc_id long, text string, label string, score double")
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict(df.coalesce(1), model).collect()]
    assert [x[1] for x in got] == ["x", "y", "und", "und", "und", "und", got[6][1], "x", "x", "x"] and got[6][1] != "und"
    assert all((s == 0) == (lang == "und") and 0 <= s <= 1 for _, lang, s in got)
    assert {r["lang_pred"] for r in langid.predict(df, None).collect()} == {"und"}
    kept = langid.keep_languages(df, model)
    assert kept.columns == df.columns and kept.count() == 6 and kept.filter("label = 'l' and score = 0.5").count() == 6
    assert langid.keep_languages(df, model, wanted=("y",)).filter("doc_id = 2").count() == 1
    assert langid.predict(df.limit(0), model).collect() == [] and langid.keep_languages(df, None).collect() == []
    assert langid.fit(df.withColumn("lang", F.lit(None).cast("string"))) is None


def test_sample_is_bounded_and_even(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 30 == 0, "rare").otherwise("common").alias("lang"))
    got = langid.sample(df, id_col="doc_id", text_col="text", label_col="lang", most_docs=100)
    assert len(got) <= 100 and sum(a == "rare" for a, _ in got) >= 35 and all(t.startswith("text ") for _, t in got)
    twice = langid.sample(df.unionByName(df), id_col="doc_id", text_col="text", label_col="lang", most_docs=100)
    assert len(twice) == len(set(twice)) >= 80


def test_all_of_a_text_is_learnt_from(spark, monkeypatch):
    """Windows of the end of a long text are drawn too."""
    seen = []
    fit = langid.BiGru.fit
    monkeypatch.setattr(langid.BiGru, "fit", lambda self, ids, label, weight, **k: (seen.append(ids), fit(self, ids, label, weight, **k))[1])
    langid.train([("x", "ab " * 40_000 + "omega"), ("y", "qz")], rounds=2)
    assert seen[0].size >= 120_000 and b"omega" in seen[0].T.tobytes()


def test_language_restated():
    """The forward pass, one byte and one text at a time."""
    m = langid.BiGru(["a", "b"], hidden=3, seed=1)
    texts = ["ab é c", "x" * 70 + " 12 y", "?!"]
    sig = lambda x: 1 / (1 + np.exp(-x))
    want = []
    for t in texts:
        raw, total, letters = t.encode(), np.zeros(2), 0
        for lo in range(0, len(raw), 64):
            w = raw[lo : lo + 64].ljust(64, b" ")
            states = {}
            for d in "fb":
                x, u, h, out = m.w[f"x{d}"], m.w[f"u{d}"], np.zeros(3), [None] * 64
                for i in range(64) if d == "f" else range(63, -1, -1):
                    a, g = x[:, w[i]], u @ h
                    z, r = sig(a[:3] + g[:3]), sig(a[3:6] + g[3:6])
                    c = np.tanh(a[6:] + r * g[6:])
                    h = out[i] = c + z * (h - c)
                states[d] = out
            for i in range(min(64, len(raw) - lo)):
                if chr(w[i]).isalpha() and w[i] < 128 or w[i] >= 128:
                    y = m.w["o"] @ np.concatenate([states["f"][i], states["b"][i]]) + m.w["c"][:, 0]
                    total += y - np.log(np.exp(y).sum())
                    letters += 1
        p = np.exp(total / letters) if letters else np.zeros(2)
        want.append(p / p.sum() if letters else p)
    raw = [t.encode() for t in texts]
    got = langid.document_scores(m, np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]), 64)
    assert np.allclose(got, want, atol=1e-4)


def test_quality_restated():
    """The forward pass, one passage at a time."""
    m = quality_mil.AttentionMil(hidden=4, attention=3)
    x = np.random.default_rng(3).normal(0, 1, (6, quality_mil.N_FEATURES)).astype(np.float32)
    p, weight = m.attend(x, np.array([0, 2, 3, 6]))
    for k, (a, b) in enumerate(((0, 2), (2, 3), (3, 6))):
        h = [np.tanh(x[i].clip(-6, 6) @ m.w["e"] + m.w["eb"]) for i in range(a, b)]
        raw = [float(sum(np.tanh(v @ m.w["v"]) / (1 + np.exp(-(v @ m.w["u"]))) * m.w["a"])) for v in h]
        e = np.exp(raw) / np.exp(raw).sum()
        z = sum(w * v for w, v in zip(e, h))
        assert np.allclose(weight[a:b], e, atol=1e-5) and np.isclose(p[k], 1 / (1 + np.exp(-(z @ m.w["c"] + m.w["b"][0]))), atol=1e-5)


def test_language_held_out(spark):
    sf = f"{DATA}/sf0.01"
    got = op4_langid(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert held[0] >= 0.97 and held[1] > 200


def test_quality_of_odd_rows(spark):
    good, bad = "some plain words that stand here, one after the other and all different. ", "BUY!! NOW!! $$$ ||| "
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([(i, (good if i % 2 else bad) * (1 + i % 5), 1.0) for i in range(80)] + [(100, None, 1.0), (101, "", 1.0), (None, good, 1.0), (102, good * 4000, 1.0), (103, "\n \t", 1.0), (101, "", 1.0)], "doc_id long, text string, score double")
    m = quality_mil.fit(df, labels, rounds=120)
    got = {r["doc_id"]: r for r in quality_mil.score(df, m).collect()}
    assert all((got[i]["score"] >= 0.5) == bool(i % 2) for i in range(80)) and got[102]["score"] > 0.5 and got[102]["n_passages"] > 100
    assert 0 <= got[100]["score"] <= 1 and got[100]["score"] == got[101]["score"] and got[100]["n_passages"] == 1
    assert quality_mil.score(df, m).count() == 86 and quality_mil.score(df.limit(0), m).collect() == []
    long = {}
    learn = quality_mil.learn
    quality_mil.learn = lambda bags, **k: (long.setdefault("n", max(len(x) for _, x in bags)), learn(bags, **k))[1]
    try:  # all passages of a text count; rows in any order and repeated rows give the same classifier
        a = quality_mil.fit(df, labels.filter("quality IS NOT NULL").unionByName(spark.createDataFrame([(102, 1, 0)], labels.schema)), rounds=20)
        b = quality_mil.fit(df.unionByName(df).repartition(5), labels.unionByName(spark.createDataFrame([(102, 1, 0)], labels.schema)).repartition(3), rounds=20)
    finally:
        quality_mil.learn = learn
    assert long["n"] == got[102]["n_passages"] and all((a.w[k] == b.w[k]).all() for k in a.w)
    assert quality_mil.fit(df, labels.limit(0)) is None and {r["score"] for r in quality_mil.score(df, None).collect()} == {0.5}


def test_attention_finds_the_bad_passage():
    good = " ".join(f"word{i} follows" for i in range(32))
    bad = "BUY!! $$$ " * 32
    r = np.random.default_rng(0)
    pairs = []
    for i in range(120):
        parts = [good] * 4
        if i % 2 == 0:
            parts[r.integers(0, 4)] = bad
        pairs.append((i % 2, " ".join(parts)))
    m = quality_mil.train(pairs, rounds=200)
    for _, _, buf, offs in slices(pa.array([" ".join([good, good, bad, good])])):
        x, bag = quality_mil.passages(buf, offs)
        p, weight = m.attend(x, bag)
        assert p[0] < 0.5 and weight.argmax() == 2


def test_quality_held_out(spark):
    sf = f"{DATA}/sf0.01"
    got = op2_quality_mil(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    r = got.select(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert r[0] >= 0.93 and r[1] > 80


def test_folds(spark):
    import zlib

    df = spark.range(200).withColumnRenamed("id", "doc_id")
    got = {r["doc_id"]: r["f"] for r in df.select("doc_id", fold(3, 1).alias("f")).collect()}
    assert all(v == (zlib.crc32(str(k).encode()) % 3 == 1) for k, v in got.items())


def test_all_documents_are_learnt_from_and_give_floors(spark, monkeypatch):
    """The pipeline's network learns what its start has never seen, and its floors are those of all held-out documents."""
    import copy

    import corpus_pipeline

    other = "qoqo vivi zuzu " * 8
    rows = [(i, f"{other}{i}" if i % 4 == 0 else f"ab ba{i} " * 6, "x") for i in range(4000)] + [(4000 + i, f"tr rt{i} " * 6, "y") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    made, start = {}, langid.train([("x", "ab ba " * 12)] * 9 + [("y", "tr rt " * 12)] * 9, rounds=60, hidden=4)
    monkeypatch.setattr(langid, "keep_languages", lambda docs, model, **k: made.update(model=model, **k) or docs)
    monkeypatch.setattr(langid, "train", lambda pairs, **k: copy.deepcopy(start))
    corpus_pipeline.language(spark, df, "")
    raw = other.encode()
    before, after = (langid.document_scores(m, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 64)[0, 0] for m in (start, made["model"]))
    assert after > before + 0.01 or after > 0.99 > before, (before, after)
    held = [r["text"] for r in df.filter(fold(4, 2)).collect()]
    want = langid.floors_from(langid.least_by_size(made["model"], sorted(held)))
    assert np.allclose(made["floors"], want) and len(held) > 1800


def test_learners_don_t_depend_on_the_order_of_rows(spark):
    rows = [(i, f"ab ba{i} " * 30 if i % 2 else f"tr rt{i} " * 30, "x" if i % 2 else "y") for i in range(60)] + [(99, None, "x"), (98, "", "y"), (97, "abc", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = langid.BiGru(["x", "y"], 2)
    a, b = (langid.fit_all(x, rounds=5, hidden=2) for x in (df, df.repartition(5)))
    assert all((a.w[k] == b.w[k]).all() and a.w[k].shape == seen.w[k].shape for k in a.w)
    assert langid.fit_all(df.limit(0)) is None and langid.floors(df.limit(0), a).tolist() == [0.0] and langid.floors(df, None).tolist() == [0.0]


def test_each_window_is_gone_through_once(monkeypatch):
    seen = []
    step = langid.BiGru.gradients
    monkeypatch.setattr(langid.BiGru, "gradients", lambda self, ids, label, weight: (seen.append((ids, weight)), step(self, ids, label, weight))[1])
    texts = ["ab " * 700 + "omega", "qz", "tr " * 50]
    langid.learn_part(langid.BiGru(["x", "y"], 2), list(zip("xyx", texts)), {"x": 1.0, "y": 0.5}, most=64)
    ids, weight = (np.concatenate(x, axis=1) for x in zip(*seen))
    want = sorted(t.encode()[i : i + 64].ljust(64).decode() for t in texts for i in range(0, len(t), 64))
    assert sorted(bytes(x).decode() for x in ids.T) == want
    each = {bytes(x)[:2]: w.max() for x, w in zip(ids.T, weight.T)}
    assert np.isclose(each[b"qz"] / each[b"tr"], 0.5 * 3)

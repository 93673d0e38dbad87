import numpy as np
from pyspark.sql import functions as F

from conftest import DATA
from spanloom.llm import chroma, queries


def tune(seed, notes=60):
    r = np.random.default_rng(seed)
    t = np.arange(512) / chroma.RATE
    return np.concatenate([sum(np.sin(2 * np.pi * 220 * 2 ** (k / 12) * t) for k in r.integers(0, 24, 3)) for _ in range(notes)]).astype(np.float32) / 3


def pcm(x):
    return (np.clip(x, -1, 1) * 30000).astype("<i2").tobytes()


def prints_of(spark, recordings):
    """num, code, sounding."""
    rows = [(k, c.astype("<u4").tobytes(), s.tobytes()) for k, x in recordings for c, s in [chroma.fingerprint(x)]]
    return spark.createDataFrame(rows, "num long, code binary, sounding binary")


def brute(queries, every, most_error=0.2, least_votes=1, least_overlap=32):
    """All pairs, all offsets."""
    out = {}
    for q, x in queries:
        qc, qs = chroma.fingerprint(x)
        for t, y in every:
            tc, ts = chroma.fingerprint(y)
            best = None
            for off in range(-len(qc) + 1, len(tc)):
                i = np.arange(max(0, -off), min(len(qc), len(tc) - off))
                same = (qc[i] == tc[i + off]) & qs[i] & ts[i + off]
                votes = int((same[:-4] & same[2:-2] & same[4:]).sum()) if len(same) > 4 else 0
                if votes >= least_votes and (best is None or (-votes, abs(off), off) < best[:3]):
                    both = qs[i] & ts[i + off]
                    error = float(np.bitwise_count(qc[i] ^ tc[i + off])[both].sum() / max(both.sum(), 1) / 32)
                    best = (-votes, abs(off), off, error, int(both.sum()))
            if best and best[3] <= most_error and best[4] >= least_overlap:
                out[q, t] = (best[2], -best[0], round(best[3], 9))
    return out


def test_align_against_brute_force(spark, monkeypatch):
    r = np.random.default_rng(2)
    every = [(i, tune(i)) for i in range(14)] + [(20, np.zeros(30_000, np.float32)), (21, np.zeros(10, np.float32)), (22, np.sin(np.arange(40_000) * 0.7).astype(np.float32))]
    asked = [(100 + i, np.concatenate([tune(50 + i, 10), tune(i)])[: 60 * 512] + r.normal(0, 0.02, 60 * 512).astype(np.float32)) for i in range(6)]
    asked += [(200 + i, tune(i)[9 * 512 :]) for i in range(6)] + [(300, every[-1][1][5000:]), (301, tune(77)), (302, every[-2][1])]
    want = brute(asked, every)
    assert sum((100 + i, i) in want and (200 + i, i) in want for i in range(6)) >= 5 and want[200, 0][0] == 9 * 512 // chroma.HOP and (300, 22) in want
    got = lambda: {(x["q"], x["t"]): (x["offset"], x["votes"], round(x["error"], 9)) for x in chroma.align(prints_of(spark, asked), prints_of(spark, every)).collect()}
    assert got() == want
    monkeypatch.setattr(chroma, "TASK_MARKS", 20)  # all tasks are parted
    monkeypatch.setattr(chroma, "LEAST_TASKS", 3)
    assert got() == want
    empty = prints_of(spark, every).limit(0)
    assert chroma.align(empty, empty).collect() == [] == chroma.align(prints_of(spark, asked), empty).collect()


def test_excerpts_of_the_querys_own_recordings_are_found(spark):
    """Recall of cut, louder and noisy recordings, and alignments with others, on the query's table."""
    got = queries.op10_chroma(spark, f"{DATA}/sf0.01").collect()
    assert len(got) >= 10
    found = [x for x in got if x["excerpt_error"] is not None]
    assert len(found) >= 0.9 * len(got) and sum(x["excerpt_others"] for x in got) <= 0.1 * len(got)
    assert all(abs(x["excerpt_offset"] - 0.3 * 64 * chroma.CHORD / chroma.HOP) <= 1 for x in found)


def test_recall_of_shifted_noisy_recordings(spark):
    r = np.random.default_rng(6)
    base = {i: r.normal(0, 0.125, 64).astype(np.float32) for i in range(120)}
    every = [(i, chroma.render(x)) for i, x in base.items()]
    asked = []
    for i in range(60):
        x = chroma.render(base[i])
        x = np.concatenate([chroma.render(base[i + 60])[: int(r.integers(2000, 9000))], x])[: len(x)]
        asked.append((1000 + i, (x + r.normal(0, 0.05 * x.std(), len(x))).astype(np.float32)))
    phased = [(1000 * k + q, x[k * chroma.HOP // 4 :]) for q, x in asked for k in range(4)]
    got = {(x["q"] % 1000, x["t"]) for x in chroma.align(prints_of(spark, [(k * 1000 + q % 1000, x) for n, (q, x) in enumerate(phased) for k in [n % 4]]), prints_of(spark, every)).collect()}
    assert sum((i, i) in got for i in range(60)) >= 54
    assert len(got - {(i, i) for i in range(60)} - {(i, i + 60) for i in range(60)}) <= 2


def test_integral_image_areas():
    f = np.random.default_rng(0).random((20, 12)).astype(np.float32)
    code, sound = chroma.pack(f)
    assert len(code) == 20 - chroma.SPAN + 1 and sound.all()
    first = chroma.FILTERS[0]
    d = np.log((f[0:4, 0:3].sum() + 0.05) / (f[4:8, 0:3].sum() + 0.05))
    t = chroma.LEVELS[first[0]]
    level = int(d > -t) + int(d > 0) + int(d > t)
    assert int(code[0]) >> 30 == [0, 1, 3, 2][level]
    assert not chroma.pack(np.zeros((20, 12)))[1].any() and len(chroma.pack(f[:3])[0]) == 0


def test_search_against_brute_force(spark):
    rows, truth = [], {}
    r = np.random.default_rng(5)
    for i in range(24):
        a = tune(100 + i)
        rows.append((i * 10, pcm(a), "x"))
        if i % 2 == 0:
            rows.append((i * 10 + 1, pcm(a), "x"))
        if i % 3 == 0:
            rows.append((i * 10 + 2, pcm(a + r.normal(0, 0.02, len(a))), "x"))
            truth[i * 10] = {i * 10 + 2}
    rows += [(900, None, "x"), (910, b"", "x"), (920, pcm(np.zeros(40_000)), "x"), (930, pcm(tune(1, 2)), "x"), (None, pcm(tune(77)), "x"), (20, rows[3][1], "x")]
    df = spark.createDataFrame(rows, "id long, audio binary, code string").repartition(3)
    prints = chroma.fingerprints(df, id_col="id", audio_col="audio")
    got = {x["id"]: x for x in chroma.search(prints, F.col("id") % 10 == 0, id_col="id").collect()}
    found = sum(len({m["id"] for m in got[k]["matches"]} & v) for k, v in truth.items())
    assert found >= 0.9 * len(truth)
    assert all({m["id"] for m in got[k]["matches"]} <= truth.get(k, set()) for k in range(0, 240, 10) if k != 20)
    assert got[0]["n_copies"] == 1 and got[0]["class_id"] == 0 and got[900]["class_id"] is None and got[920]["n_matches"] == 0
    assert chroma.search(prints.limit(0), F.lit(True), id_col="id").collect() == []
    assert chroma.search(prints, F.lit(False), id_col="id").collect() == []


def test_parted_tasks_change_nothing(spark, monkeypatch):
    rows = [(i, pcm(tune(i % 7) + np.random.default_rng(i).normal(0, 0.01, 60 * 512))) for i in range(30)]
    prints = chroma.fingerprints(spark.createDataFrame(rows, "id long, audio binary"), id_col="id", audio_col="audio")
    shape = lambda: sorted((r["id"], r["n_matches"], tuple(m["id"] for m in r["matches"])) for r in chroma.search(prints, F.col("id") < 10, id_col="id").collect())
    one = shape()
    assert all(n >= 3 for _, n, _ in one)
    monkeypatch.setattr(chroma, "TASK_MARKS", 50)
    assert shape() == one


def test_rendered_vectors(spark):
    v = np.random.default_rng(3).normal(0, 0.1, 64).astype(np.float32)
    near = v + np.random.default_rng(4).normal(0, 0.002, 64).astype(np.float32)
    a, b, c = (chroma.fingerprint(chroma.render(x))[0] for x in (v, near, v[::-1]))
    share = lambda x, y: np.bitwise_count(x ^ y).mean() / 32
    assert share(a, b) < 0.1 < 0.25 < share(a, c)
    df = spark.createDataFrame([(1, [float(x) for x in v]), (2, None), (3, [])], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["n"] for r in chroma.fingerprints(df, id_col="vec_id", audio_col="embedding", decode=chroma.render).collect()}
    assert got[1] == len(a) and got[2] == got[3] == 0


def test_all_matches_are_listed(spark):
    r = np.random.default_rng(3)
    base = r.normal(0, 1, 64)
    rows = [(i, [float(x) for x in base + r.normal(0, 0.02, 64)]) for i in range(12)]
    prints = chroma.fingerprints(spark.createDataFrame(rows, "id long, v array<float>"), id_col="id", audio_col="v", decode=chroma.render)
    got = chroma.search(prints, F.col("id") == 0, id_col="id", most_error=0.4).first()
    assert got["n_matches"] > 5 and len(got["matches"]) == got["n_matches"]

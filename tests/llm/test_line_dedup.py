import random

from pyspark.sql import functions as F

from spanloom.llm.line_dedup import drop_common_lines, line_key

WS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WS))


def brute(rows, least, chars=1):
    seen = {}
    for i, t in set(rows):
        for line in (t or "").split("\n"):
            seen.setdefault(key(line), set()).add((i, t or ""))
    bad = {k for k, v in seen.items() if len(k) >= chars and len(v) >= least}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in bad]
        out.append((i, "\n".join(kept) if len(kept) < len(lines) else t, len(lines), len(lines) - len(kept)))
    return out


def norm(rows):
    return sorted(((i is None, i or 0, t or "", a, b) for i, t, a, b in rows))


def test_against_brute_force(spark):
    r = random.Random(3)
    pool = ["Common LINE", " common line\t", "other", "", "  ", "É x", "é x", "CC BY", "z" * 50]
    rows = [(i, "\n".join(r.choice(pool + [f"own {i} {j}" for j in range(3)]) for _ in range(r.randint(0, 12)))) for i in range(60)]
    rows += [(None, "common line\nnull id"), (5, None), (6, ""), rows[0], rows[0]]
    df = spark.createDataFrame([(*x, "keep", 1) for x in rows], "doc_id long, text string, row string, id int")
    for least, chars in ((2, 1), (5, 1), (10, 4)):
        got = drop_common_lines(df, min_docs=least, min_chars=chars, counts=("n_lines", "n_dropped"))
        assert got.columns == ["doc_id", "text", "row", "id", "n_lines", "n_dropped"]
        assert norm((x["doc_id"], x["text"], x["n_lines"], x["n_dropped"]) for x in got.collect()) == norm(brute(rows, least, chars))
    assert drop_common_lines(df.limit(0)).collect() == [] and drop_common_lines(df).columns == df.columns


def test_a_line_of_all_documents_and_a_long_text(spark):
    rows = [(i, "everywhere\nown " + str(i)) for i in range(300)] + [(300, "\n".join(["everywhere"] * 3000 + [f"l{i}" for i in range(3000)]))]
    got = {x["doc_id"]: x for x in drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string"), counts=("a", "b")).collect()}
    assert got[7]["text"] == "own 7" and got[300]["b"] == 3000 and got[300]["text"].startswith("l0\nl1")


def test_key(spark):
    df = spark.createDataFrame([(" \x0bÀB c\r",), (" X",)], "t string")
    assert [x[0] for x in df.select(line_key(F.col("t"))).collect()] == ["Àb c", " x"]

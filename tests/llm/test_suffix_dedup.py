import random
import re

import numpy as np
import pytest
from test_textbuf import twins

from spanloom.llm import suffix_dedup
from spanloom.llm.suffix_dedup import common_lengths, deep_nodes, remove_repeats


def brute(rows, window=13):
    top = 1 << 62
    w = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (k, _), x in zip(rows, w):
        for i in range(len(x) - window + 1):
            s = tuple(x[i : i + window])
            least[s] = min(least.get(s, top), top if k is None else k)
    out = []
    for (k, _), x in zip(rows, w):
        gone = {i + j for i in range(len(x) - window + 1) if least[tuple(x[i : i + window])] < (top if k is None else k) for j in range(window)}
        out.append((k is None, k or 0, len(x), len(gone), " ".join(v for i, v in enumerate(x) if i not in gone)))
    return sorted(out)


def corpus(n, seed):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + r.choice("xyzé") + str(r.randrange(30))
    shared = [[word() for _ in range(r.randint(13, 60))] for _ in range(12)]
    rows = []
    for i in range(n):
        x = []
        for _ in range(r.randint(0, 6)):
            x += r.choice(shared) if r.random() < 0.4 else [word() for _ in range(r.randint(1, 40))]
        rows.append((i * 2, r.choice([" ", "\n", " \t"]).join(x)))
    rows += [(2000 + i, rows[5][1]) for i in range(5)] + [(3000, None), (3001, ""), (None, rows[7][1]), (None, rows[7][1]), rows[9], (-4, rows[11][1]), (4000, "loop " * 60), (4001, "loop " * 13)]
    return rows


@pytest.mark.parametrize("chunk,group", [(1 << 20, 100_000), (700, 100_000), (700, 12), (1, 1)])
def test_against_brute_force(spark, monkeypatch, chunk, group):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(suffix_dedup, "GROUP_SUFFIXES", group)
    monkeypatch.setattr(suffix_dedup, "LEAST_TASKS", 5)
    rows = corpus(60, 7)
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, chunk int, kept string").repartition(3)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept"]) for r in remove_repeats(df).collect())
    assert got == brute(rows)


def test_other_windows_and_an_empty_table(spark):
    rows = corpus(20, 8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept"]) for r in remove_repeats(df, window=6, k=3).collect())
    assert got == brute(rows, 6)
    assert remove_repeats(df.limit(0)).collect() == []


def test_tree_nodes():
    rows = np.array([[1, 1, 1], [1, 1, 2], [1, 1, 2], [1, 3, 0], [2, 2, 2], [2, 2, 2], [2, 2, 2]])
    lcp = common_lengths(rows)
    assert lcp.tolist() == [0, 2, 3, 1, 0, 3, 3]
    assert [x.tolist() for x in deep_nodes(lcp, 3)] == [[1, 4], [3, 7]]
    assert [x.tolist() for x in deep_nodes(lcp, 1)] == [[0, 4], [4, 7]]
    assert [x.tolist() for x in deep_nodes(common_lengths(rows[:0]), 1)] == [[], []]


def test_all_nodes_of_a_tree():
    lcp = np.array([0, 4, 3, 5, 0, 3, 3])
    assert [tuple(int(v) for v in x) for x in zip(*suffix_dedup.tree_nodes(lcp, 3))] == [(0, 4, 3), (4, 7, 3), (0, 2, 4), (2, 4, 5)]
    assert [len(x) for x in suffix_dedup.tree_nodes(lcp[:0], 3)] == [0, 0, 0]


def test_prefixes_grow_word_by_word(spark, monkeypatch):
    """A hot phrase: its suffixes go by prefixes of several lengths, as many as fit, and no group is larger."""
    r = random.Random(4)
    phrase = [f"p{i}" for i in range(5)]
    rows = []
    for i in range(60):
        tail = [["t0", "t1", "t2"], ["t0", "t1", "u2"], ["t0", "v1", "v2"], [f"w{i % 4}", "w1", "w2"]][i % 4]
        rest = [f"r{i % 6}{j}" for j in range(8)] if i % 5 else [f"q{r.randrange(99)}" for _ in range(8)]
        rows.append((i, " ".join([f"a{i % 3}", *phrase, *tail, *rest, *(f"z{i}{j}" for j in range(5))])))
    rows += [(100 + i, "one and the same window of thirteen words that all of these have") for i in range(30)]
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 1)
    monkeypatch.setattr(suffix_dedup, "GROUP_SUFFIXES", 12)
    seen, trees, grown, most = {}, suffix_dedup._hot_trees, suffix_dedup._hot_repeats, spark.sparkContext.accumulator(0)

    def counted(*a):
        parts, used = grown(*a)
        seen.update(used)
        return parts, used

    monkeypatch.setattr(suffix_dedup, "_hot_repeats", counted)
    assert trees
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((False, x["doc_id"], x["n_words"], x["n_removed"], x["kept"]) for x in remove_repeats(df).collect())
    assert got == brute(rows)
    assert sum(n > 0 for n in seen.values()) >= 3 and seen[13] >= 30


def test_words_that_polynomial_hashes_confuse(spark):
    a, b = twins(1024)
    same = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{same} {a}"), (2, f"{same} {b}"), (3, f"{same} {a}"), (4, f"x {same} {twins(4096)[0]}"), (5, f"x {same} {twins(4096)[1]}")]
    got = sorted((False, x["doc_id"], x["n_words"], x["n_removed"], x["kept"]) for x in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows) and [x[3] for x in got] == [0, 0, 13, 0, 13]


def test_repeats_are_the_longest_runs_and_odd_ids_are_null(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    rows = [("1", f"start {passage} end"), ("2", f"{passage} mid words {passage}"), ("no number", passage)]
    got = {x["doc_id"]: [tuple(y) for y in x["repeats"]] for x in remove_repeats(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {1: [], 2: [(0, 30), (32, 30)], None: [(0, 30)]}

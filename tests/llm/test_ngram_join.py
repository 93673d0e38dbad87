import random
import re

import numpy as np
import pytest

from test_textbuf import twins

from spanloom.llm import ngram_join, shared
from spanloom.llm.components import components


def grams(t, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, threshold=0.8):
    s = [grams(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and len(s[i] & s[j]) >= threshold * len(s[i] | s[j]) - 1e-12:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted(((k is None, k or 0, least.get(find(i)) if s[i] else k, links[i]) for i, (k, _) in enumerate(rows)), key=repr)


def corpus(n=40, seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdef") for _ in range(4))
    rows = []
    for i in range(n):
        base = [word() for _ in range(r.choice([3, 8, 60, 200]))]
        for _ in range(r.choice([1, 1, 2, 5])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2])):
                copy[r.randrange(len(copy))] = word()
            rows.append((len(rows) * 3, " ".join(copy)))
    return rows


@pytest.fixture
def odd_rows():
    rows = corpus()
    return rows + [(9001, None), (9002, ""), (9003, " \n"), (None, rows[3][1]), (None, "all alone in the null world today"), rows[5], (9004, "one two"), (9005, "one  two")]


@pytest.mark.parametrize("block", [2048, 3])
def test_against_brute_force(spark, odd_rows, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in odd_rows], "doc_id long, text string, node string, key int")
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["class_id"], r["n_links"]) for r in ngram_join.near_duplicates(df).collect()), key=repr)
    assert got == brute(odd_rows)


def test_a_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAST_BLOCK", 8)
    r = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        c = list(base)
        c[r.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(c)))
    got = sorted(((False, x["doc_id"], x["class_id"], x["n_links"]) for x in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == brute(rows)


def test_empty_table_and_keep_one(spark, odd_rows):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in odd_rows], "doc_id long, text string, row string, id int")
    assert ngram_join.near_duplicates(df.limit(0)).collect() == []
    kept = ngram_join.keep_one(df)
    want = [(no, k) for no, k, least, _ in brute(odd_rows) if no or least is None or k == least]
    got = sorted((x["doc_id"] is None, x["doc_id"] or 0) for x in kept.collect())
    assert kept.columns == df.columns and set(got) == set(want)


def test_keep_one_keeps_one_row_of_each_class(spark, odd_rows):
    alone, other = "all alone in the null world today", "this text of a repeated id is like no other one"
    rows = odd_rows + [odd_rows[0], odd_rows[0], (None, alone), (None, alone), (odd_rows[9][0], other), (odd_rows[9][0], odd_rows[0][1]), (9001, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(x) for x in ngram_join.keep_one(df).collect()]
    s, root = [grams(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]) - 1e-12:
                root = [root[j] if x == root[i] else x for x in root]
    classes = {}
    for i, (k, t) in enumerate(rows):
        classes.setdefault(root[i], []).append((k, t))
    assert len(kept) == len(classes)
    order = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(order, kept)) == sorted(min(map(order, c)) for c in classes.values())
    of = {r: c for c, members in classes.items() for r in members if grams(r[1])}
    full = [of[r] for r in kept if grams(r[1])]
    assert len(set(full)) == len(full) and sorted(r for r in kept if r[0] == 9001) == [(9001, None)] * 2
    assert kept.count((None, alone)) == 1 and kept.count((odd_rows[9][0], other)) == 1


def test_words_that_polynomial_hashes_confuse(spark):
    rows = []
    for n in (1024, 4096):
        a, b = twins(n)
        rows += [(len(rows) + i, f"one two three four {x}") for i, x in enumerate((a, b, a))] + [(len(rows) + 3, a), (len(rows) + 4, b)]
    got = sorted(((False, x["doc_id"], x["class_id"], x["n_links"]) for x in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == brute(rows) and sum(x[3] for x in got) == 4


def chained(n, copies, seed=3):
    """Pages of which each shares a passage with the one before, at a similarity of 0.3 to 0.5, and near copies of some."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    passages = [[word() for _ in range(40)] for _ in range(n + 1)]
    rows = []
    for i in range(n):
        page = passages[i // 3] + passages[i // 3 + 1] + [word() for _ in range(15)]
        rows.append((len(rows), " ".join(page)))
        if i % 10 == 0:
            for _ in range(copies):
                copy = list(page)
                copy[r.randrange(len(copy))] = word()
                rows.append((len(rows), " ".join(copy)))
    return rows


def test_chained_boilerplate_is_not_connected(spark, monkeypatch):
    """Links as by brute force, and pairs and sets that are compared grow in proportion to the pages."""
    import pyspark.sql.functions as F

    made = {}
    write = ngram_join.written

    def count(df, name, *by):
        out = write(df, name, *by)
        made[name] = max(made.get(name, 0), out.count()) if name in ("pairs", "near") else made.get(name, 0)
        if name == "members":
            made[name] = out.groupBy("grp").count().agg(F.max("count")).first()[0]
        return out

    monkeypatch.setattr(ngram_join, "written", count)
    seen = []
    for n in (100, 400):
        made.clear()
        rows = chained(n, 3)
        got = sorted(((False, x["doc_id"], x["class_id"], x["n_links"]) for x in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
        assert got == brute(rows)
        seen.append(dict(made))
    assert seen[1]["near"] <= 5 * seen[0]["near"] and seen[1]["pairs"] <= 5 * seen[0]["pairs"]
    assert seen[0]["members"] <= 8 >= seen[1]["members"]  # no class larger than a page and its copies


def test_copies_among_pages_of_one_template(spark):
    """Pages that share most of a template fill the same buckets; copies of them are found all the same."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    template, rows, planted = [word() for _ in range(120)], [], []
    for i in range(120):
        page = template + [word() for _ in range(60)]
        rows.append((2 * i, " ".join(page)))
        copy = list(page)
        copy[r.randrange(len(copy))] = word()
        rows.append((2 * i + 1, " ".join(copy)))
        planted.append(2 * i)
    got = {x["doc_id"]: x["class_id"] for x in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[k] == got[k + 1] for k in planted) >= 0.99 * len(planted) and len(set(got.values())) >= 118


def test_joins_on_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_ROWS", 5)
    monkeypatch.setattr(shared, "HOT_SHARE", 0.1)
    rows = spark.createDataFrame([(1 if i < 60 else i, i) for i in range(100)] + [(None, i) for i in range(40)], "k long, v long")
    keyed = spark.createDataFrame([(1, "a"), (61, "b"), (500, "c")], "k long, w string")
    for how in ("inner", "left", "left_semi"):
        want = sorted(map(tuple, rows.join(keyed, ["k"], how).collect()), key=repr)
        assert sorted(map(tuple, shared.join_on(rows, keyed, ["k"], how).collect()), key=repr) == want


def test_tables_of_a_scope_are_removed(spark):
    import os

    with shared.scope(spark):
        t = shared.written(spark.range(5), "kept")
        path = t.inputFiles()[0].removeprefix("file://")
        assert t.count() == 5 and os.path.exists(path)
    assert not os.path.exists(path)


def test_banding_meets_the_recall():
    for t, recall in ((0.8, 0.9999), (0.8, 0.9), (0.5, 0.99)):
        b, r = ngram_join.bands_for(t, recall)
        assert 1 - (1 - t**r) ** b >= recall and b * r <= 128
    with pytest.raises(ValueError):
        ngram_join.bands_for(0.01, 0.9999)


def test_linked_against_sets():
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 60, 300).astype(np.uint64)
    sets = [np.unique(np.where(r.random(300) < p, r.integers(0, 1 << 60, 300).astype(np.uint64), base)) for p in [0, 0.02, 0.05, 0.1, 0.2] * 16]
    copies = r.integers(1, 4, len(sets))
    for side in (np.zeros(len(sets), int), r.integers(0, 2, len(sets))):
        links = ngram_join.linked(sets, copies, side, 0.8)
        want = np.zeros(len(sets), int)
        for i in range(len(sets)):
            for j in range(len(sets)):
                if i != j and not (side.any() and side[i] == side[j]):
                    a, b = set(sets[i].tolist()), set(sets[j].tolist())
                    if len(a & b) / len(a | b) >= 0.8:
                        want[i] += copies[j]
        assert links.tolist() == want.tolist()


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(0, i) for i in range(150, 170)] + [(i, i + 1) for i in range(300, 340)] + [(7, None), (9, 9)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {x["node"]: x["label"] for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: find(k) for k in root}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_bridges_connect_what_links_connect():
    sets = [np.array(x) for x in ([1, 2, 3, 4, 5], [1, 2, 3, 4, 5, 6], [9, 10], [9, 10, 11], [1, 2, 3, 4, 6])]
    one = np.zeros(5, np.int64)
    assert sorted(ngram_join.bridges(sets, np.arange(5), one, 0.8)) == [(0, 1), (1, 4)]
    assert ngram_join.bridges(sets, np.array([0, 0, 1, 2, 0]), one, 0.8) == []
    assert ngram_join.bridges(sets, np.arange(5), np.array([0, 1, 0, 1, 1]), 0.8) == [(0, 1)]


def test_pairs_of_crowded_buckets_are_all_compared(spark):
    """Pairs just over 0.8 among pages at 0.7 to each other, so that strangers are in nearly all of a pair's buckets."""
    page, table = [f"w{i}" for i in range(104)], []
    for g in range(200):
        one = page + [f"x{g}y{i}" for i in range(21)]
        two = [f"z{g}" if i in (g % 90, g % 90 + 4, g % 90 + 8) else w for i, w in enumerate(one)]
        table += [(2 * g, " ".join(one)), (2 * g + 1, " ".join(two))]
    got = {x["doc_id"]: (x["class_id"], x["n_links"]) for x in ngram_join.near_duplicates(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert got == {i: (least, n) for _, i, least, n in brute(table)}


def test_rows_of_crowded_buckets_grow_with_their_nodes(spark, monkeypatch):
    """A node of a bucket remains once however many blocks the bucket has; blocks and chunks of any size give what brute force gives."""
    page, table = [f"w{i}" for i in range(104)], []
    for g in range(150):
        one = page + [f"x{g}y{i}" for i in range(21)]
        two = [f"z{g}" if i in (g % 90, g % 90 + 4, g % 90 + 8) else w for i, w in enumerate(one)]
        table += [(2 * g, " ".join(one)), (2 * g + 1, " ".join(two))]
    df, made, write = spark.createDataFrame(table, "doc_id long, text string"), {}, ngram_join.written

    def count(rows, name, *by):
        out = write(rows, name, *by)
        made[name] = out.count() if name in ("crowd", "rest") else 0
        return out

    monkeypatch.setattr(ngram_join, "written", count)
    monkeypatch.setattr(ngram_join, "LEAST_BLOCK", 8)
    for small in (False, True):
        if small:
            for name, size in (("SKETCHES", 40), ("MOST_BLOCKS", 3), ("BLOCK_SETS", 30), ("BLOCK_GRAMS", 2000)):
                monkeypatch.setattr(ngram_join, name, size)
        got = {x["doc_id"]: (x["class_id"], x["n_links"]) for x in ngram_join.near_duplicates(df).collect()}
        assert got == {i: (least, n) for _, i, least, n in brute(table)}
        assert 0 < made["rest"] <= made["crowd"]


def test_chunks():
    assert ngram_join.chunks(np.array([3, 3, 3, 9, 1, 1]), 2, 8) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert ngram_join.chunks(np.array([], np.int64), 2, 8) == []

import random
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

import restated as plain
from spanloom.backends.ner import model_spans
from spanloom.functions import detect, names, places, rules, spans
from spanloom.functions.detect import Detector

FIXED = [
    ("D01", "NIN: 90000000011", ["90000000011"]), ("D02", "NIN: 90000000011", ["90000000011"]), ("D03", "Passport A00000001", ["A00000001"]), ("D03", "a00000001", ["a00000001"]),
    ("D04", "Tel +234 801 000 0001 Next", ["234 801 000 0001 "]), ("D04", "0601 000 0001", []), ("D05", "Plate ZZZ 000 QQ", ["ZZZ 000 QQ"]), ("D06", "00AA 11BB 2222 3333 4444", ["00AA 11BB 2222 3333 4444"]),
    ("D06", "seen abundant evidence", []), ("D07", "ZZZ00000QQ00", ["ZZZ00000QQ00"]), ("D08", "TIN 00000000 -0001", ["00000000 -0001"]), ("D09", "0000000001", ["0000000001"]), ("D14", "0000000001", ["0000000001"]),
    ("D10", "PEN000000000001", ["PEN000000000001"]), ("D11", "NYSC/ZZ/YYY/2000/000001", ["NYSC/ZZ/YYY/2000/000001"]), ("D12", "ZZ/00A/0001", ["ZZ/00A/0001"]), ("D13", "RC 0000001", ["RC 0000001"]),
    ("D16", "write a.b@c.example.org.", ["a.b@c.example.org"]), ("D16b", "ssn 123-45-6789", ["123-45-6789"]), ("D01", "é90000000011", []), ("D09", "x0000000001", []),
]


def column(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r["x"] for r in df.select("i", expr(F.col("text")).alias("x")).orderBy("i").collect()]


def test_fixed_cases_of_each_rule(spark):
    by = {r.rule_id: r for r in rules.RULES}
    for i in by:
        cases = [(t, want) for k, t, want in FIXED if k == i]
        got = column(spark, [t for t, _ in cases], lambda c, r=by[i]: rules.rule_places(c, r))
        assert [[p["text"] for p in x] for x in got] == [w for _, w in cases], i
    assert {k for k, _, _ in FIXED} == set(by)


def random_texts(n=160, seed=1):
    r = random.Random(seed)
    bits = ["90000000011", "0803 123 4567", "+234 803 123 4567", " A12345678", "KJA-123 QQ", "00AA 11BB 2222 3333 4444", "ZZZ00000QQ00", "12345678 - 1234", "1234567890", "PEN123456789012", "NYSC/ZZ/2000/12345", "ZZ/00A/0001", "RC-12345", "a@b.co", "Mr. ", "Dr ", "Full Name: ", "Name:\n", "Emeka ", "Zuma Adewale", "Grace O'Neil", "The Peter", "Home Address", "Ikeja", "obi", "Ibadan North-East", "FCT Abuja", "Shuwa Arab", "Edo", "12 Hill Road", "7b, Old Market Close", "ọmọ", "é", "😀", " ", "\n", ", ", "-", "x", "NIN", "bank verification ", "Ade-Bola's ", "123-45-6789"]
    return ["", "  ", *["".join(r.choice(bits) + r.choice(["", " ", " ", "\n"]) for _ in range(r.randint(1, 14))) for _ in range(n)]]


def test_rules_against_a_restatement(spark):
    texts = random_texts()
    for rule in rules.RULES:
        got = column(spark, texts, lambda c, r=rule: rules.rule_places(c, r))
        assert [[(p["start"], p["end"]) for p in x] for x in got] == [plain.rule_matches(t, rule) for t in texts], rule.rule_id


def test_names_addresses_and_places_against_a_restatement(spark):
    texts = random_texts(seed=2)
    got = column(spark, texts, lambda c: names.name_places(c))
    assert [sorted((p["start"], p["end"], round(p["score"], 6)) for p in x) for x in got] == [plain.people(t) for t in texts]
    listed = {"LGA": {a for a, _ in places.SAMPLE_LGAS}, "STATE_OF_ORIGIN": {*places.STATES, *places.STATE_ALIASES}, "ETHNIC_GROUP": places.ETHNIC_GROUPS}
    for kind, rx in places.DEFAULT.patterns().items():
        got = column(spark, texts, lambda c, p=rx: places.term_places(c, p))
        assert [[(p["start"], p["end"]) for p in x] for x in got] == [plain.terms(t, listed[kind]) for t in texts], kind


@given(st.lists(st.text(alphabet="ab -", min_size=1, max_size=6).map(str.strip).filter(lambda t: t[:1].isalpha() and t[-1:].isalpha()), min_size=1, max_size=8), st.text(alphabet="ab -c", max_size=40))
@settings(max_examples=300, deadline=None)
def test_prefix_tree_patterns_choose_the_longest(listed, text):
    import re

    got = [(m.start(), m.end()) for m in re.finditer(places.any_of(listed), text, re.IGNORECASE)]
    assert got == plain.terms(text, listed)


def test_names_as_published_and_mended(spark):
    texts = ["Full Name: Zuma Adewale", "Name:\nHome Address", "Mr. Emeka Zuma", "Mr. said that he", "Zuma Adewale came", "The Adewale came", "Name: Home Address", "12 Example Hill Road", "Name: Comfort Zed\nHome"]
    got = column(spark, texts, lambda c: names.name_places(c))
    assert [[(p["text"], round(p["score"], 2)) for p in x] for x in got] == [[("Zuma Adewale", 0.77)], [], [("Emeka Zuma", 0.82)], [("said that he", 0.75)], [("Zuma Adewale", 0.6)], [], [("Home Address", 0.7)], [], [("Comfort Zed", 0.77)]]
    mended = names.NameRules(compat=False)
    got = column(spark, texts, lambda c: names.name_places(c, mended))
    assert [[p["text"] for p in x] for x in got][3] == [] and [[p["text"] for p in x] for x in got][6] == []
    assert "abdullahi" in mended.parts and "abdullahi" not in names.DEFAULT.parts
    assert [p["text"] for p in column(spark, texts, lambda c: names.address_places(c))[7]] == ["12 Example Hill Road"]


def span(a, b, kind, score, source, ord_=0, text=""):
    return {"start": a, "end": b, "src": rules.SRC[source], "ord": ord_, "entity_type": kind, "score": score, "source": source, "text": text[a:b]}


TRUNCATED = "Full Name: Zuma Adewale"
FOLDS = [
    ([span(11, 22, "PERSON_NAME", 0.97, "ner"), span(11, 23, "PERSON_NAME", 0.85, "local_context")], [(11, 23, "PERSON_NAME", 0.97, "ner")]),
    ([span(0, 4, "LGA", 0.85, "local_context", 0), span(0, 4, "STATE_OF_ORIGIN", 0.85, "local_context", 1)], [(0, 4, "LGA", 0.85, "local_context")]),
    ([span(0, 6, "PERSON_NAME", 0.65, "pattern"), span(2, 9, "PERSON_NAME", 0.7, "local_context")], [(0, 9, "PERSON_NAME", 0.7, "local_context")]),
    ([span(0, 5, "PERSON", 0.85, "pattern"), span(3, 9, "LOCATION", 0.85, "pattern")], [(3, 9, "LOCATION", 0.85, "pattern")]),
    ([span(0, 5, "LGA", 0.85, "local_context"), span(5, 9, "LGA", 0.85, "local_context")], [(0, 5, "LGA", 0.85, "local_context"), (5, 9, "LGA", 0.85, "local_context")]),
    ([span(0, 9, "NG_NIN", 0.6, "pattern"), span(4, 12, "LGA", 0.85, "local_context")], [(4, 12, "LGA", 0.85, "local_context")]),
]


def folded(spark, lists, text):
    df = spark.createDataFrame([(i, text, x) for i, x in enumerate(lists)], f"i int, text string, s {spans.SPANS}")
    return [r["x"] for r in df.select("i", spans.resolve(F.col("s"), F.col("text"), rules.SOURCE_TYPES).alias("x")).orderBy("i").collect()]


def test_fold_fixed_cases(spark):
    got = folded(spark, [a for a, _ in FOLDS], TRUNCATED)
    assert [[(s["start"], s["end"], s["entity_type"], s["score"], s["source"]) for s in x] for x in got] == [w for _, w in FOLDS]
    assert got[0][0]["text"] == "Zuma Adewale"


def test_fold_against_a_restatement_and_its_properties(spark):
    r = random.Random(4)
    text = "áb😀" * 10
    kinds = ["PERSON_NAME", "LGA", "NG_NIN", "PERSON", "ADDRESS"]
    lists = []
    for _ in range(400):
        x = []
        for i in range(r.randint(0, 9)):
            a = r.randint(0, 25)
            x.append(span(a, a + r.randint(1, 5), r.choice(kinds), r.choice([0.5, 0.6, 0.85]), r.choice(list(rules.SRC)), i, text))
        lists.append(x)
    got = [[s.asDict() for s in x] for x in folded(spark, lists, text)]
    assert got == [plain.resolve(x, text) for x in lists]
    assert folded(spark, got, text) == [] or [[s.asDict() for s in x] for x in folded(spark, got, text)] == [plain.resolve(x, text) for x in got]
    for x in got:
        assert all(a["start"] <= b["start"] for a, b in zip(x, x[1:]))


def test_whole_detection(spark):
    texts = ["Applicant: Grace Adewale, NIN: 90000000011 of Edo, LGA Nasarawa", None, "  ", "nothing here"]
    got = column(spark, texts, lambda c: detect.detect(c))
    assert [(s["entity_type"], s["text"], s["score"]) for s in got[0]] == [("PERSON_NAME", "Grace Adewale", 0.85), ("NG_NIN", "90000000011", 0.95), ("STATE_OF_ORIGIN", "Edo", 0.85), ("LGA", "Nasarawa", 0.85)]
    assert got[1:] == [[], [], []]
    only = column(spark, texts, lambda c: Detector(types=("NG_BVN", "LGA")).detect(c))
    assert [s["entity_type"] for s in only[0]] == ["NG_BVN", "LGA"]
    for name in ("Bauchi", "Ebonyi", "Ekiti", "Gombe", "Katsina", "Kogi", "Nasarawa"):
        assert [s["entity_type"] for s in column(spark, [f"from {name}."], lambda c: detect.detect(c))[0]] == ["LGA"]


def test_listed_names_and_a_model(spark):
    d = Detector(deny=("Zed Quux",))
    text = "zed quux met Emeka Zed"
    got = column(spark, [text], lambda c: d.detect(c))[0]
    assert [(s["text"], s["source"]) for s in got][0] == ("zed quux", "pattern")
    df = spark.createDataFrame([(text,), (None,)], "text string")
    cloudpickle.register_pickle_by_value(plain)  # workers don't see the tests' folder
    m = model_spans(F.col("text"), lambda: plain.WordListBackend(("emeka",)))
    rows = df.withColumn("m", m).select("m", d.detect(F.col("text"), F.col("m")).alias("x")).collect()
    assert [s["entity_type"] for s in rows[0]["m"]] == ["PER"] and rows[1]["x"] == []
    assert ("Emeka Zed", "ner", "PERSON_NAME") in [(s["text"], s["source"], s["entity_type"]) for s in rows[0]["x"]]


def test_gazetteer_state_of_areas():
    by = places.DEFAULT.state_of()
    assert [by[x] for x in ("Obi", "Nasarawa", "Bassa", "Ifelodun", "Irepodun", "Surulere")] == ["Nasarawa", "Nasarawa", "Plateau", "Osun", "Osun", "Oyo"]


def test_unrequested_rules_are_not_planned(spark):
    df = spark.createDataFrame([("x",)], "text string").select(rules.pattern_spans(F.col("text"), ("NG_TIN",)).alias("x"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "PEN" not in plan and "{8}" in plan
    assert rules.pattern_spans(F.col("text"), ()) is not None


@pytest.mark.parametrize("text", ["0 " * 20_000, "A" * 40_000, "Ab " * 20_000, "1234567890 " * 5_000])
def test_long_texts(spark, text):
    assert column(spark, [text], lambda c: F.size(detect.detect(c)))[0] >= 0


def test_two_more_parts_of_names(spark):
    df = spark.createDataFrame([("Oluwatoni Omitogun",), ("after mr Oluwatoni Omitogun",)], "text string")
    got = [[(s["text"], round(s["score"], 2)) for s in r["x"]] for r in df.select(names.name_places(F.col("text")).alias("x")).collect()]
    assert got == [[("Oluwatoni Omitogun", 0.7)], [("Oluwatoni Omitogun", 0.9)]]


def test_running_sums_and_clusters(spark):
    r = random.Random(3)
    lists = [[r.randint(0, 9) for _ in range(n)] for n in (0, 1, 63, 64, 65, 200, 1000)]
    df = spark.createDataFrame([(x,) for x in lists], "v array<int>")
    rows = df.select(spans.running(F.col("v"), lambda a, b: a + b).alias("s"), spans.running(F.col("v"), F.greatest).alias("m")).collect()
    for x, row in zip(lists, rows):
        assert row["s"] == [sum(x[: i + 1]) for i in range(len(x))] and row["m"] == [max(x[: i + 1]) for i in range(len(x))]


def test_marks_in_a_text_and_words_before_a_match(spark):
    """Characters that the engine uses itself may stand in a text; context is the same whatever stands between."""
    texts = ["\x01NIN 90000000011\x02\x01 90000000011", "NIN" + " x" * 60 + " 90000000011", "nin 1 2 90000000011 90000000011 90000000011", "NIN é 90000000011", "", "\x01"]
    rule = next(r for r in rules.RULES if r.rule_id == "D01")
    got = [[(s["start"], s["end"], s["score"]) for s in r["x"]] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(rules.rule_spans(F.col("text"), rule, 0).alias("x")).collect()]
    for t, found in zip(texts, got):
        want = plain.rule_matches(t, rule)
        assert [x[:2] for x in found] == want
        for a, _, score in found:
            near = " ".join(re.sub(r"\s+", " ", t[max(0, a - 100) : a]).strip().split(" ")[-5:]).lower()
            assert score == (0.95 if "nin" in near else 0.6)


def test_work_grows_with_a_texts_length(spark):
    """Twice the text takes about twice the time, from texts of forms; a fold that copied its results would take four times."""
    import time

    base = "Mr Emeka Adewale lives at 12 Hill Road in Ikeja, Lagos. NIN: 90000000011, mail a.b@c.example.org, TIN 12345678 -0001.\n"
    df = lambda n: spark.createDataFrame([(base * n,)], "text string")
    count = lambda d: d.select(F.size(Detector().detect(F.col("text"))).alias("n")).first()["n"]
    assert count(df(3)) == 3 * count(df(1))
    took, found = [], []
    for n in (1000, 4000, 8000):  # 0.12 to 1 MB
        d = df(n).cache()
        d.count()
        began = time.perf_counter()
        found.append(count(d))
        took.append(time.perf_counter() - began)
    assert found[2] == 2 * found[1] == 8 * found[0] > 40_000
    assert took[2] < 2.6 * took[1] + 1


def test_a_full_list_of_areas(spark, tmp_path):
    """774 areas by a rule, some names in two states, from a file: all are found, each with its last state."""
    import json

    name = lambda i: f"{'BCDFGHJKLM'[i % 10]}a{'bcdfghjklm'[i // 10 % 10]}o{'bcdfghjklm'[i // 100]}u" + (" North" if i % 7 == 0 else "")
    by = {}
    for i in range(768):
        by.setdefault(f"State {i % 37}", []).append(name(i))
    for i in range(6):
        by["State 36"].append(name(i))
    (tmp_path / "g.json").write_text(json.dumps({"states": sorted(by), "lgas_by_state": by}))
    from spanloom.sources import gazetteer

    d = gazetteer.detector(spark, str(tmp_path / "g.json"))
    assert len(d.gazetteer.lgas) == 774 and len(d.gazetteer.state_of()) == 768 and d.gazetteer.state_of()[name(3)] == "State 36"
    df = spark.createDataFrame([(i, f"in {name(i).upper()} area") for i in range(768)], "i int, text string")
    got = {r["i"]: [s["text"] for s in r["x"] if s["entity_type"] == "LGA"] for r in df.select("i", d.detect(F.col("text")).alias("x")).collect()}
    assert all(got[i] == [name(i).upper()] for i in range(768))


def test_widened_spans_are_the_resolved_ones_that_no_source_found(spark):
    from conftest import DATA

    from spanloom.plans.queries import DENY, forms

    texts, d = [*random_texts(), None, *(r["text"] for r in forms(spark, f"{DATA}/sf0.001").limit(20).collect())], Detector(deny=DENY)
    place = lambda s: (s["start"], s["end"])
    raw = [{place(s) for s in x or []} for x in column(spark, texts, d.union)]
    resolved, got = (column(spark, texts, f) for f in (d.detect, d.widened))
    assert got == [[s for s in x if place(s) not in r] for x, r in zip(resolved, raw, strict=True)] and any(got)


def test_widened_names_are_found_row_by_row(spark):
    from conftest import DATA

    from spanloom.plans.queries import widened_names

    plan = widened_names(spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan

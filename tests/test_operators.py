import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

import restated as plain
from spanloom.functions import spans
from spanloom.functions.detect import Detector
from spanloom.operators import audit, documents, evaluate, name_lists, redact, review, workflow
from spanloom.sources import files, gazetteer
from spanloom.streaming import redact as streaming

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
p = lambda *runs: "<w:p>" + "".join(f'<w:r><w:t xml:space="preserve">{t}</w:t></w:r>' for t in runs) + "</w:p>"
cell = lambda *x: f"<w:tc>{''.join(x)}</w:tc>"
tbl = lambda *cells: f"<w:tbl><w:tr>{''.join(cells)}</w:tr></w:tbl>"


def docx():
    out = io.BytesIO()
    body = p("Name: Grace ", "Adewale") + p("") + p("NIN 90000000011 and 90000000011") + tbl(cell(p("cell A00000001"), tbl(cell(p("inner 90000000011")))), cell(p(" "))) + '<w:sectPr><w:headerReference w:type="default" r:id="rId1"/></w:sectPr>'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {W}>{p('head A00000001')}</w:hdr>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="rId1" Target="header1.xml"/></Relationships>')
        z.writestr("docProps/x.xml", "<a/>")
    return out.getvalue()


def test_docx_to_segments_to_redacted_file(spark):
    f = spark.createDataFrame([(1, "a.docx", bytearray(docx())), (2, "b.docx", bytearray(b"no zip"))], "doc_id long, path string, content binary")
    seg = files.docx_segments(f)
    rows = [(r["part"], r["seg_no"], r["paragraph_index"], r["text"]) for r in seg.filter("doc_id = 1").orderBy("seg_no").collect()]
    assert rows == [("body", 0, 1, "Name: Grace Adewale"), ("body", 1, 3, "NIN 90000000011 and 90000000011"), ("tables", 2, 4, "cell A00000001"), ("tables", 3, 5, "inner 90000000011"), ("headers_footers", 4, 7, "head A00000001")]
    assert seg.filter("doc_id = 2").first()["part"] == "error"
    seg = seg.filter("part <> 'error'")
    found = seg.withColumn("entities", Detector().detect(F.col("text")))
    e = documents.numbered(_entities(found), order=("seg_no", "start"))
    done = redact.redact_segments(seg, review.approved(e))
    trail = {r["text"]: (r["paragraph_indices"], r["occurrence_count"]) for r in redact.audit_trail(done, e).collect()}
    assert trail["90000000011"] == ([3, 3, 5], 3) and trail["A00000001"] == ([4, 7], 2)
    assert redact.summary(done).first().asDict() == {"doc_id": 1, "entities_matched": 3, "paragraphs_redacted": 5}
    out = files.redacted_files(f.filter("doc_id = 1"), done).first()["content"]
    texts = [t for _, t in files.docx_paragraphs(bytes(out))]
    assert texts == ["Name: [REDACTED]", "", "NIN [REDACTED] and [REDACTED]", "cell [REDACTED]", "inner [REDACTED]", " ", "head [REDACTED]"]
    assert b"<a/>" in zipfile.ZipFile(io.BytesIO(out)).read("docProps/x.xml")


def _entities(found):
    rows = found.select("doc_id", "seg_no", F.explode("entities").alias("e")).select("doc_id", "seg_no", "e.start", "e.end", "e.entity_type", "e.score", "e.source", "e.text")
    return documents.first_by_text(rows)


def test_claims_and_rewriting_against_a_restatement(spark):
    r = random.Random(1)
    cases = [("Ado Ekiti is in Ekiti", ["Ekiti", "Ado Ekiti", None, ""]), ("aaaa", ["aa", "aaa"]), ("x\\Ey", ["\\E"]), ("", ["a"]), ("😀a😀", ["a"])]
    for _ in range(200):
        t = "".join(r.choice("abc é") for _ in range(r.randint(0, 20)))
        cases.append((t, ["".join(r.choice("abc é") for _ in range(r.randint(1, 3))) for _ in range(r.randint(0, 4))]))
    df = spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(cases)], "i int, t string, v array<string>").withColumn("c", redact.claims(F.col("t"), F.col("v")))
    for row in df.withColumn("r", redact.rewrite(F.col("t"), F.col("c"))).collect():
        t, values = cases[row["i"]]
        want = plain.claims(t, list(dict.fromkeys(filter(None, values))))
        assert [(c["start"], c["end"], c["value"]) for c in row["c"]] == want
        out, at = "", 0
        for a, b, _ in want:
            out, at = out + t[at:a] + redact.LABEL, b
        assert row["r"] == out + t[at:]


def test_rewrite_passes_over_stale_places(spark):
    s = "array<struct<start:int,end:int>>"
    got = spark.createDataFrame([("abcdef", [(1, 3), (2, 5), (4, 99), (50, 60)])], f"t string, s {s}").select(redact.rewrite(F.col("t"), F.col("s"), "#")).first()[0]
    assert got == "a#d#"


def test_page_assembly_classes_and_flags(spark):
    w = [(1, 0, 5, 1, 1, 1, 1, 60.0, "12"), (1, 0, 5, 1, 1, 1, 2, 59.0, "Hill"), (1, 0, 5, 1, 1, 2, 1, 90.0, "Road"), (1, 0, 5, 2, 1, 1, 1, 80.0, "NIN"), (1, 0, 5, 2, 1, 1, 2, 40.0, "90000000011"), (1, 0, 4, 1, 1, 1, 0, -1.0, ""), (1, 0, 5, 1, 1, 1, 3, -1.0, "gone"), (1, 0, 5, 1, 1, 1, 4, 50.0, " "), (1, 1, 5, 1, 1, 1, 1, 50.0, "thin but text here")]
    words = spark.createDataFrame(w, "doc_id long, page_num int, level int, block_num int, par_num int, line_num int, word_num int, conf double, text string")
    pages = documents.assemble(documents.ocr_words(words), keep=("conf",))
    row = pages.filter("page_num = 0").first()
    assert row["page_text"] == "12 Hill\nRoad\nNIN 90000000011"
    assert [(b["start"], b["end"]) for b in row["blocks"]] == [(0, 12), (12, 28)]
    assert [(x["start"], x["end"]) for x in row["words"]] == [(0, 2), (3, 7), (8, 12), (13, 16), (17, 28)]
    done = documents.with_confidence(documents.detect_blocks(pages))
    got = {e["entity_type"]: (e["text"], e["ocr_confidence"], e["low_confidence"]) for e in done.filter("page_num = 0").first()["entities"]}
    assert got["ADDRESS"] == ("12 Hill\nRoad", 59.0, True) and got["NG_NIN"] == ("90000000011", 40.0, True)
    f = documents.flagged(done)
    assert documents.flagged_pages(f).first()["flagged_pages"] == [1]
    r = documents.rects(documents.detect_blocks(pages).withColumn("words", F.transform("words", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("rect")))))
    assert {x["entity_type"]: x["rects"] for x in r.collect()}["ADDRESS"] == ["12", "Hill", "Road"]
    cls = spark.createDataFrame([(" " * 30,), ("12345678901234",), ("123456789012345",), (None,)], "t string").select(documents.page_class(F.col("t"))).collect()
    assert [c[0] for c in cls] == ["scanned", "scanned", "text", "scanned"]


def test_addresses_are_stitched(spark):
    t = "12 Hill Road\n3 Palm Close x 4 Old Lane"
    s = [(0, 12, 1, 0, "ADDRESS", 0.5, "a", t[:12]), (13, 25, 1, 1, "ADDRESS", 0.6, "b", t[13:25]), (28, 38, 1, 2, "ADDRESS", 0.5, "c", t[28:38])]
    got = spark.createDataFrame([(t, s)], f"t string, s {spans.SPANS}").select(spans.stitch(F.col("s"), F.col("t")).alias("x")).first()["x"]
    assert [(x["start"], x["end"], x["score"], x["source"]) for x in got] == [(0, 25, 0.6, "a"), (28, 38, 0.5, "c")] and got[0]["text"] == t[:25]


ENTITY = "doc_id long, id long, entity_type string, text string, start int, end int, score double, source string, approved boolean"


def entities(spark):
    return spark.createDataFrame([(1, 0, "NG_NIN", "a", 0, 1, 0.6, "pattern", True), (1, 1, None, "b", 2, 3, 0.6, "pattern", True), (1, 2, "NG_NUBAN", "c", 4, 5, 0.4, "pattern", None), (2, 0, "LGA", "d", 0, 1, 0.8, "local_context", False)], ENTITY)


def test_policies_and_decisions(spark):
    e = entities(spark)
    assert review.policy_types("Custom") == frozenset() and review.policy_types("Custom", ["LGA", "X"]) == {"LGA"}
    assert "PERSON" not in review.policy_types("Full NDPA profile") and len(review.UNIVERSE) == 21
    with pytest.raises(ValueError):
        review.policy_types("No such")
    ok = lambda df: [r["approved"] for r in df.orderBy("doc_id", "id").collect()]
    assert ok(review.approve_types(e, review.policy_types("Financial IDs only"))) == [False, False, True, False]
    assert ok(review.approve_types(e, ())) == [False] * 4 and ok(review.approve_types(e, review.policy_types(review.EVERYTHING))) == [True] * 4
    d = spark.createDataFrame([(1, 0, False), (2, 0, True)], "doc_id long, entity_id long, approved boolean")
    assert ok(review.decide(e, d)) == [False, True, None, True]
    bad = spark.createDataFrame([(2, 7, True)], "doc_id long, entity_id long, approved boolean")
    with pytest.raises(KeyError):
        review.decide(e, bad)
    assert ok(review.decide(e, bad, strict=False)) == [True, True, None, False]
    assert review.approved(e).count() == 3
    s = {r["doc_id"]: r for r in review.summary(e).collect()}
    assert (s[1]["n_approved"], s[1]["n_rejected"], s[1]["n_ambiguous"], s[2]["n_rejected"]) == (3, 0, 1, 1)
    assert [r["id"] for r in review.review_order(e.withColumn("page_num", F.lit(0)), "pdf").collect()] == [0, 1, 2, 0]


def test_additions_by_hand(spark):
    seg = spark.createDataFrame([(1, 0, "Zed met ZED and zed. Zed"), (2, 0, "none"), (1, 1, "Q zed")], "doc_id long, page_num int, text string")
    e = entities(spark)
    got = review.add_by_text(seg, e, "  zed ", "PERSON_NAME")
    assert sorted((r["id"], r["text"], r["start"]) for r in got.collect()) == [(3, "ZED", None), (4, "Zed", None), (5, "zed", None)]
    both = e.unionByName(got.select(*e.columns))
    assert review.add_by_text(seg, both, "zed", "PERSON_NAME").count() == 0 and review.add_by_text(seg, both, "zed", "LGA").count() == 3
    paged = review.add_by_text(seg, e.withColumn("page_num", F.lit(0)), "zed", "LGA", per_place=True)
    assert [(r["page_num"], r["start"], r["id"]) for r in paged.orderBy("id").collect()] == [(0, 0, 3), (0, 8, 4), (0, 16, 5), (0, 21, 6), (1, 2, 7)]
    assert review.add_by_text(seg, e, "  ", "LGA").count() == 0 and review.add_by_text(seg, e, "a.b\\E", "LGA").count() == 0


def test_audit_texts(spark):
    rows = [("B", 0.955, None, [3, 3, 9], 3), ("A", None, None, list(range(1, 9)), 8), ("A", 1.0, None, None, 1), ("C", 0.5, None, None, None), ("D", 0.5, None, [], 2)]
    t = spark.createDataFrame([(1, *r) for r in rows], "doc_id long, entity_type string, score double, page_num int, paragraph_indices array<int>, occurrence_count long")
    got = [(r["entity_type"], r["location"], r["confidence_text"]) for r in audit.detail(audit.records(t, "docx")).collect()]
    assert got == [("A", "Paragraph(s) 1, 2, 3, 4, 5, 6, ... (+2 more) (8 occurrences)", "N/A"), ("B", "Paragraph(s) 3, 3, 9 (3 occurrences)", "95.5%"), ("A", "1 occurrence (paragraph list unavailable)", "100.0%"), ("C", "Location unavailable", "50.0%"), ("D", "2 occurrences (paragraph list unavailable)", "50.0%")]
    pdf = spark.createDataFrame([("X", 0.5, 4), (None, 0.5, None)], "entity_type string, score double, page_num int")
    assert [(r["entity_type"], r["location"]) for r in audit.detail(audit.records(pdf, "pdf")).collect()] == [("X", "Page 5"), ("UNKNOWN", "Page unknown")]
    assert [(r["entity_type"], r["n"]) for r in audit.by_type(audit.records(t, "docx")).collect()] == [("A", 2), ("B", 1), ("C", 1), ("D", 1)]


def test_scores(spark):
    truth = spark.createDataFrame([("r", "NIN", "123"), ("r", "NIN", "123"), ("r", "Name", "Zed Q-x"), ("r", "Place", "Here"), ("e", "NIN", "9")], "run string, type string, item string")
    texts = spark.createDataFrame([("r", 'Zed Q-x has 123 and 123, (Here) or "cat" x123', "[REDACTED] has [REDACTED] and 123, (Here) or x123 Here-after"), ("e", "9", "9"), ("n", "a b", "a b")], "run string, original string, redacted string")
    items = {(r["run"], r["type"]): (r["items_ok"], r["items_total"], r["leaked"]) for r in evaluate.item_recall(truth, texts).collect()}
    assert items == {("r", "NIN"): (0, 2, ["123", "123"]), ("r", "Name"): (1, 1, []), ("r", "Place"): (0, 1, ["Here"]), ("e", "NIN"): (0, 1, ["9"])}
    s = {r["run"]: r for r in evaluate.word_scores(truth, texts).collect()}
    assert (s["r"]["tp"], s["r"]["fp"], s["r"]["fn"], s["r"]["collateral"]) == (3, 1, 2, ["cat"])
    assert abs(s["r"]["f1"] - 2 * 0.75 * 0.6 / 1.35) < 1e-9
    assert (s["e"]["precision"], s["e"]["recall"], s["e"]["f1"]) == (0, 0, 0) and s["n"]["tp"] == 0
    rep = {r["run"]: r for r in evaluate.report(truth, texts).collect()}
    assert json.loads(rep["r"]["per_type"])["NIN"] == {"items_ok": 0, "items_total": 2}


def test_name_lists(spark):
    lines = ["Adé B-PER", "Ọlá I-PER", "x O", "Bola B-PER", "Kuti B-PER", "", "Ojo I-PER", "a b c", "Lost I-PER", "in O", "Gone I-PER", "The B-PER", "O'Neil B-PER", "- I-PER", "Zed I-PER", "Jo B-PER"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no long, line string")
    got = name_lists.person_spans(df)
    assert {r["span"] for r in got.collect()} == {"Adé Ọlá", "Bola", "Kuti Ojo Lost", "The", "O'Neil - Zed", "Jo"}
    names = [r["name"] for r in name_lists.build(got).collect()]
    assert names == sorted(names) and {"Adé Ọlá", "Ade Ola", "Bola", "Kuti", "Kuti Ojo Lost", "Lost", "O'Neil-Zed"} <= set(names)
    assert not {"The", "Jo", "Ojo", "Adé"} & set(names)


def test_sources_and_sinks(spark, tmp_path):
    g = {"states": ["A", "B"], "lgas_by_state": {"A": ["X", "Y"], "B": ["Y", "Z z"]}}
    (tmp_path / "g.json").write_text(json.dumps(g))
    rows = gazetteer.read_gazetteer(spark, str(tmp_path / "g.json"))
    assert {r["lga"]: r["state"] for r in gazetteer.state_of(rows).collect()} == {"X": "A", "Y": "B", "Z z": "B"}
    assert gazetteer.gazetteer(spark, str(tmp_path / "g.json")).state_of() == {"X": "A", "Y": "B", "Z z": "B"}
    (tmp_path / "n.json").write_text(json.dumps(["Zed Quux", "Zed"]))
    names = gazetteer.read_names(spark, str(tmp_path / "n.json"))
    texts = spark.createDataFrame([(1, "zed quux, and\nZed")], "doc_id long, text string")
    assert sorted((r["start"], r["text"]) for r in gazetteer.listed_names(texts, names).collect()) == [(0, "zed quux"), (14, "Zed")]
    gazetteer.write_names(names, str(tmp_path / "out"))
    assert sorted(r["name"] for r in gazetteer.read_names(spark, str(tmp_path / "out")).collect()) == ["Zed", "Zed Quux"]
    long = spark.createDataFrame([(1, "zed quux " * 20_000)], "doc_id long, text string")
    assert gazetteer.listed_names(long, names).count() == 20_000
    (tmp_path / "a.txt").write_text("Zed B-PER\n\nx O\n")
    c = files.read_conll(spark, str(tmp_path / "a.txt"), str(tmp_path / "missing.txt"))
    assert [(r["line_no"], r["line"]) for r in c.orderBy("line_no").collect()] == [(0, "Zed B-PER"), (1, ""), (2, "x O"), (3, "")]
    assert files.read_conll(spark, str(tmp_path / "none.txt")).collect() == []
    words = spark.createDataFrame([(5, 1, 1, 1, 1, 10, 20, 30, 40, 96.0, "Hi"), (5, 1, 1, 1, 2, 10, 20, 30, 40, -1.0, "lo"), (5, 1, 1, 1, 3, 1, 1, 1, 1, 9.0, " ")], files.OCR_CSV)
    files.write_ocr_csv(words.coalesce(1), str(tmp_path / "ocr"))
    assert [(r["text"], r["conf"]) for r in files.read_ocr_csv(spark, str(tmp_path / "ocr")).collect()] == [("Hi", 96.0), ("lo", -1.0)]
    m = files.manifest(entities(spark).withColumn("path", F.lit("a")).withColumn("file_type", F.lit("docx")).withColumn("created_at", F.lit("t")))
    files.write_manifest(m, str(tmp_path / "m"))
    back = files.read_manifest(spark, str(tmp_path / "m")).first()
    assert back["file_type"] == "docx" and len(back["spans"]) == 4 and back["spans"][0]["location"] is not None


def test_routing(spark):
    df = spark.createDataFrame([("/a.b/X.DOCX",), ("y.pdf",), ("z.Tif",), ("noext",), ("q.xlsx",)], "path string")
    assert [r["file_type"] for r in files.route(df, strict=False).collect()] == ["docx", "pdf", "image", None, None]
    with pytest.raises(Exception, match="unsupported file type"):
        files.route(df).collect()
    k = spark.createDataFrame([("File is ENCRYPTED",), ("Bad zip file",), (None,)], "m string").select(review.error_kind(F.col("m"))).collect()
    assert [x[0] for x in k] == ["password", "corrupt", "other"]


def test_page_readers_and_boxes(spark):
    f = spark.createDataFrame([(1, bytearray(b"one two"))], "doc_id long, content binary")
    read = lambda raw: [{"page_num": 0, "level": 5, "block_num": 1, "line_num": 1, "word_num": i, "x0": 300.0 * i, "y0": 0.0, "x1": 300.0 * i + 150, "y1": 75.0, "conf": 90.0, "text": t} for i, t in enumerate(raw.decode().split())]
    w = files.page_words(f, read)
    assert [(r["x0"], r["x1"]) for r in files.scaled(w).orderBy("word_num").collect()] == [(0.0, 36.0), (72.0, 108.0)]
    box = spark.createDataFrame([(a, 10.0, 20.0, 30.0, 25.0, 100.0, 200.0) for a in (0, 90, 180, 270, 45)], "rotation int, x0 double, y0 double, x1 double, y1 double, width double, height double")
    got = [(r["x0"], r["y0"], r["x1"], r["y1"]) for r in files.turned(box).collect()]
    assert got[0] == got[4] == (10, 20, 30, 25) and got[2] == (70, 175, 90, 180)
    assert all(x0 <= x1 and y0 <= y1 for x0, y0, x1, y1 in got)


def test_preview(spark):
    seg = spark.createDataFrame([(1, 0, "a <b> & d"), (1, 1, " ")], "doc_id long, seg_no int, text string")
    e = spark.createDataFrame([(1, 0, "T", "<b>", 0, 1, 1.0, "pattern", True), (1, 1, "T", "d", 0, 1, 1.0, "manual", False), (1, 2, "T", "a", 0, 1, 1.0, "x", False)], ENTITY)
    html = [r["html"] for r in redact.preview(seg, e).collect()]
    mark = lambda c, t: f'<mark style="background-color:{c}; padding:1px 2px; border-radius:3px;">{t}</mark>'
    assert html == [f"<p>{mark(redact.REJECTED, 'a')} {mark(redact.APPROVED, '&lt;b&gt;')} &amp; {mark(redact.MANUAL, 'd')}</p>"]
    o = spark.createDataFrame([(True, "manual"), (True, "x"), (False, "x")], "a boolean, s string").select(redact.overlay_colour(F.col("a"), F.col("s"))).collect()
    assert [x[0] for x in o] == ["manual", "approved", "rejected"]


def test_streaming_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"NIN 9000000{i:04d} here") for i in range(20)], "doc_id long, text string")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows.repartition(4).write.parquet(src)
    s = streaming.redact_stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src))
    q = streaming.append_to(s.select("doc_id", "redacted"), out, str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["doc_id"]: r["redacted"] for r in spark.read.parquet(out).collect()}
    assert got == {i: "NIN [REDACTED] here" for i in range(20)}
    timed = streaming.redact_stream(rows.withColumn("ts", F.timestamp_seconds(F.col("doc_id") * 60)))
    assert sum(r["n"] for r in streaming.type_counts(timed).collect()) == 20


def test_evaluation_reads_forms_of_any_key(spark, monkeypatch):
    from spanloom.plans import queries

    sf = "/root/testdata/sf0.001"
    want = queries._runs(spark, sf)[0].count()
    moved = queries.forms(spark, sf).withColumn("doc_id", F.col("doc_id") + 2_000_000_000)
    monkeypatch.setattr(queries, "forms", lambda *_: moved)
    assert queries._runs(spark, sf)[0].count() == want > 0


def test_listed_names_of_many_words(spark):
    texts = spark.createDataFrame([(1, "So Ann Bea Cy Dee Eve Fay said")], "doc_id long, text string")
    names = spark.createDataFrame([("ann bea cy dee eve fay",)], "name string")
    assert [(r["start"], r["text"]) for r in gazetteer.listed_names(texts, names).collect()] == [(3, "Ann Bea Cy Dee Eve Fay")]


def test_whole_documents(spark):
    """V01 and V10 on files of several kinds."""
    reader = lambda content: [{"page_num": 0, "level": 5, "block_num": 1, "line_num": 1, "word_num": i, "conf": 50.0 + i, "text": t} for i, t in enumerate(content.decode().split())]
    f = spark.createDataFrame([(1, "a.docx", bytearray(docx())), (2, "b.pdf", bytearray(b"NIN 90000000011 Lagos")), (3, "c.docx", bytearray(b"no zip"))], "doc_id long, path string, content binary")
    rows = workflow.detect_document(f, reader=reader).orderBy("doc_id", "id").collect()
    got = [(r["doc_id"], r["id"], r["file_type"], r["entity_type"], r["text"]) for r in rows]
    assert [x[:2] for x in got if x[0] == 1] == [(1, i) for i in range(sum(x[0] == 1 for x in got))] and {x[0] for x in got} == {1, 2}
    assert (1, 0, "docx", "PERSON_NAME", "Grace Adewale") in got and [(x[2], x[3], x[4]) for x in got if x[0] == 2][-1] == ("pdf", "STATE_OF_ORIGIN", "Lagos")
    assert [r["ocr_confidence"] for r in rows if r["text"] == "Lagos"] == [52.0] and all(r["approved"] for r in rows)
    out, trail = workflow.redact_document(f.filter("doc_id = 1"))
    texts = [t for _, t in files.docx_paragraphs(bytes(out.first()["content"]))]
    assert texts[0] == "Name: [REDACTED]" and "90000000011" not in " ".join(texts)
    assert {r["text"]: r["occurrence_count"] for r in trail.collect()}["90000000011"] == 3
    with pytest.raises(Exception, match="unsupported"):
        workflow.detect_document(spark.createDataFrame([(1, "a.txt", bytearray(b""))], "doc_id long, path string, content binary")).collect()


def test_a_value_that_is_the_label_changes_nothing(spark):
    seg = spark.createDataFrame([(1, 0, 1, "[REDACTED] x"), (1, 1, 2, "x y")], "doc_id long, seg_no int, paragraph_index int, text string")
    e = spark.createDataFrame([(1, 0, "[REDACTED]", "A", 1.0, "m"), (1, 1, "y", "B", 1.0, "m"), (1, 2, "y", "C", 0.5, "m")], "doc_id long, id long, text string, entity_type string, score double, source string")
    done = redact.redact_segments(seg, e, keep=True)
    assert [(r["redacted"], r["changed"]) for r in done.orderBy("seg_no").collect()] == [("[REDACTED] x", False), ("x [REDACTED]", True)]
    key = lambda d: sorted((r["text"], r["entity_type"], r["occurrence_count"]) for r in d.collect())
    assert key(redact.audit_trail(done)) == key(redact.audit_trail(done, e)) == [("[REDACTED]", "A", 1), ("y", "C", 1)]


def test_scores_by_document(spark):
    """A run of several documents is scored document by document."""
    truth = spark.createDataFrame([("r", 1, "N", "111"), ("r", 2, "N", "222")], "run string, doc_id long, type string, item string")
    texts = spark.createDataFrame([("r", 1, "a 111 222", "a [REDACTED] 222"), ("r", 2, "222 b", "222 [REDACTED]")], "run string, doc_id long, original string, redacted string")
    assert [(r["doc_id"], r["left"]) for r in evaluate.item_hits(truth, texts).orderBy("doc_id").collect()] == [(1, False), (2, True)]
    r = evaluate.report(truth, texts, lists=False).first()
    assert (r["tp"], r["fp"], r["fn"], r["items_ok"], r["items_total"]) == (1, 1, 1, 1, 2)


def test_joins_with_entities_are_not_broadcast(spark):
    """Spark takes the size of what is found in a text from the table's keys, so a driver would gather it."""
    e = entities(spark)
    d = spark.createDataFrame([(1, 0, False)], "doc_id long, entity_id long, approved boolean")
    seg = spark.createDataFrame([(1, 0, 1, "a b")], "doc_id long, seg_no int, paragraph_index int, text string")
    f = spark.createDataFrame([(1, "a.docx", bytearray(docx()))], "doc_id long, path string, content binary")
    done = redact.redact_segments(seg, e, keep=True)
    for out in (done, files.redacted_files(f, done), review.decide(e, d), review.unknown_decisions(e, d)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_entities_are_looked_for_once_for_decisions(spark):
    from conftest import DATA

    from spanloom.plans import queries

    for query in (queries.decisions_applied, queries.unknown_decisions):
        plan = query(spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "customer" not in plan and "entities-" in plan

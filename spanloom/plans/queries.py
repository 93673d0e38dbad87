"""Queries of the redaction operators over the given tables. The names carry on in oracles.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import names, places, rules, spans
from ..functions.detect import Detector
from ..operators import audit, documents, evaluate, name_lists, redact, review, workflow
from ..sources import files, gazetteer
from ..tables import written
from . import corpus

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: What a text with a voter number always has: four groups of four, and one more letter or digit.
VIN_GUARD = r"(?i)[A-Z0-9]{4}[\s\x85\p{Z}-]?[A-Z0-9]{4}[\s\x85\p{Z}-]?[A-Z0-9]{4}[\s\x85\p{Z}-]?[A-Z0-9]{4}[\s\x85\p{Z}-]?[A-Z0-9]"
DENY = ("Zuma Adewale", "Ngozi Zubair", "Grace")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def made(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """Rows of a SQL text over some of the tables."""
    for t in tables:
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(sql)


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forms. Their keys are a few MB in one file, the work on them is not: keys are dealt out before texts are made."""
    keys = table(spark, sf_dir, "customer").select("c_custkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys.createOrReplaceTempView("customer")
    return spark.sql(corpus.forms_sql())


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms(spark, sf_dir).createOrReplaceTempView("forms")
    return spark.sql(corpus.segments_sql())


def _flat(df: DataFrame, places_: Column, *keep: str, **more: Column) -> DataFrame:
    """A row per place: doc_id, start_at, end_at, text."""
    return df.select(*(keep or ("doc_id",)), F.explode(places_).alias("p")).select(*(keep or ("doc_id",)), F.col("p.start").cast("bigint").alias("start_at"), F.col("p.end").cast("bigint").alias("end_at"), F.col("p.text").alias("match"), *[v.alias(k) for k, v in more.items()])


def _entities(df: DataFrame, found: Column, *keep: str) -> DataFrame:
    cols = keep or ("doc_id",)
    e = df.select(*cols, F.explode(found).alias("e"))
    return e.select(*cols, F.col("e.start").cast("bigint").alias("start_at"), F.col("e.end").cast("bigint").alias("end_at"), "e.entity_type", "e.score", "e.source", F.col("e.text").alias("match"))


@query
def fixed_id_spans(spark, sf_dir):
    """Valid matches of each rule in the forms."""
    text = F.col("text")
    every = F.concat(*[F.transform(rules.rule_places(text, r), _tagged(r)) for r in rules.RULES])
    return _flat(forms(spark, sf_dir), every, rule_id=F.col("p.rule_id"), entity_type=F.col("p.entity_type"))


def _tagged(r: rules.PatternRule):
    return lambda p: F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.entity_type).alias("entity_type"), p["start"].alias("start"), p["end"].alias("end"), p["text"].alias("text"))


@query
def fixed_id_counts(spark, sf_dir):
    """A02 over D01 to D16."""
    return fixed_id_spans(spark, sf_dir).groupBy("rule_id", "entity_type").agg(F.count(F.lit(1)).alias("n"))


def _rule(i: str) -> rules.PatternRule:
    return next(r for r in rules.RULES if r.rule_id == i)


@query
def phone_validated(spark, sf_dir):
    """Matches and valid ones in the forms, by document."""
    r = _rule("D04")
    raw = spans.matches(F.col("text"), spans.ANY_CASE + r.regex, guard=r.guard)
    return forms(spark, sf_dir).select("doc_id", F.size(raw).cast("bigint").alias("n_raw"), F.size(rules.rule_places(F.col("text"), r)).cast("bigint").alias("n_valid"))


@query
def vin_raw_vs_validated(spark, sf_dir):
    """Matches and valid ones in all documents, by language."""
    r = _rule("D06")
    raw = spans.matches(F.col("text"), spans.ANY_CASE + r.regex, guard=VIN_GUARD)
    n = table(spark, sf_dir, "documents").select("lang", spans.let(raw, lambda m: F.struct(F.size(m).alias("a"), F.size(F.filter(m, lambda p: r.valid(p["text"]))).alias("b"))).alias("n")).select("lang", "n.*")
    return n.groupBy("lang").agg(F.sum("a").alias("n_raw"), F.sum("b").alias("n_valid"))


@query
def email_spans_documents(spark, sf_dir):
    """Addresses of electronic mail in all documents."""
    return _flat(table(spark, sf_dir, "documents"), rules.rule_places(F.col("text"), _rule("D16")))


@query
def context_boosted_scores(spark, sf_dir):
    """Scores of all rules in the forms, with what their context adds."""
    return _entities(forms(spark, sf_dir), rules.pattern_spans(F.col("text")))


@query
def requested_types_only(spark, sf_dir):
    """Two types asked for, only their rules planned."""
    return _entities(forms(spark, sf_dir), rules.pattern_spans(F.col("text"), ("NG_TIN", "NG_NYSC")))


@query
def deny_list_hits(spark, sf_dir):
    """Listed names."""
    return _flat(forms(spark, sf_dir), places.term_places(F.col("text"), places.any_of(DENY)))


@query
def deny_list_joined(spark, sf_dir):
    """D15 as a join, for lists beyond a pattern; case counts for neither."""
    listed = spark.createDataFrame([(x,) for x in DENY], "name string")
    got = gazetteer.listed_names(forms(spark, sf_dir), listed)
    return got.select("doc_id", F.col("start").cast("bigint").alias("start_at"), F.col("end").cast("bigint").alias("end_at"), F.col("text").alias("match"))


@query
def lga_hits_by_state(spark, sf_dir):
    """Areas in the forms, by their state."""
    g = places.DEFAULT
    areas = spark.createDataFrame([(a, s, i) for i, (a, s) in enumerate(g.lgas)], "lga string, state string, ord int")
    by = gazetteer.state_of(areas)
    hits = _flat(forms(spark, sf_dir), places.term_places(F.col("text"), g.patterns()["LGA"]))
    joined = hits.join(F.broadcast(by), F.lower("match") == F.lower("lga"), "left")  # a list of places, of bounded size
    return joined.groupBy("state", "lga").agg(F.count(F.lit(1)).alias("n"))


@query
def state_hits(spark, sf_dir):
    """G03."""
    return _flat(forms(spark, sf_dir), places.term_places(F.col("text"), places.DEFAULT.patterns()["STATE_OF_ORIGIN"]))


@query
def ethnic_hits(spark, sf_dir):
    """G04."""
    return _flat(forms(spark, sf_dir), places.term_places(F.col("text"), places.DEFAULT.patterns()["ETHNIC_GROUP"]))


@query
def titled_names(spark, sf_dir):
    """C01."""
    return _flat(forms(spark, sf_dir), spans.matches(F.col("text"), names.DEFAULT.title, 1))


@query
def labelled_names(spark, sf_dir):
    """A blank field gives nothing."""
    return _flat(forms(spark, sf_dir), spans.matches(F.col("text"), names.DEFAULT.label, 1, guard=":"))


@query
def bare_names(spark, sf_dir):
    """Shapes of names with their share of known parts and whether a filter takes them."""
    m = F.col("p.text")
    return _flat(forms(spark, sf_dir), spans.matches(F.col("text"), names.SHAPE), share=F.round(names.fragment_share(m), 6), is_stop=F.coalesce(names.is_stop_phrase(m), F.lit(False)), is_form=names.is_form_phrase(m))


@query
def name_scores(spark, sf_dir):
    """C06."""
    return _flat(forms(spark, sf_dir), names.name_places(F.col("text")), score=F.round("p.score", 6))


@query
def addresses(spark, sf_dir):
    """C07."""
    return _flat(forms(spark, sf_dir), names.address_places(F.col("text")))


@query
def context_detections(spark, sf_dir):
    """Places, names and addresses before resolution."""
    return _entities(forms(spark, sf_dir), Detector().context(F.col("text")))


@query
def union_counts(spark, sf_dir):
    """Detections of each source before resolution, by document."""
    d = Detector(deny=DENY)
    f = forms(spark, sf_dir)
    return f.select("doc_id", F.size(d.pattern(F.col("text"))).cast("bigint").alias("n_pattern"), F.size(d.context(F.col("text"))).cast("bigint").alias("n_context"))


@query
def merged_entities(spark, sf_dir):
    """Resolved entities of the forms, listed names among the sources."""
    return _entities(forms(spark, sf_dir), Detector(deny=DENY).detect(F.col("text")))


@query
def merged_counts_by_source(spark, sf_dir):
    """Entities by source and type."""
    return merged_entities(spark, sf_dir).groupBy("source", "entity_type").agg(F.count(F.lit(1)).alias("n"))


@query
def widened_names(spark, sf_dir):
    """Names that no source found at the place they have after resolution."""
    return _entities(forms(spark, sf_dir), Detector(deny=DENY).widened(F.col("text")))


@query
def merged_documents(spark, sf_dir):
    """M06 over all documents: entities by type."""
    found = _entities(table(spark, sf_dir, "documents"), Detector().detect(F.col("text")))
    return found.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query
def uncovered_chars(spark, sf_dir):
    """Characters that some source found and no resolved entity covers, by document: what resolution across types gives up."""
    d, t = Detector(deny=DENY), F.col("text")
    cover = lambda s: F.array_distinct(F.flatten(F.transform(s, lambda x: F.sequence(x["start"], x["end"] - 1))))
    return forms(spark, sf_dir).select("doc_id", F.size(F.array_except(cover(d.union(t)), cover(d.detect(t)))).cast("bigint").alias("n"))


def ocr_words(spark, sf_dir) -> DataFrame:
    w = made(spark, sf_dir, corpus.ocr_words_sql(), "supplier").withColumn("rect", F.struct(F.col("lft").cast("double").alias("x0"), F.col("top").cast("double").alias("y0"), (F.col("lft") + F.col("width")).cast("double").alias("x1"), (F.col("top") + F.col("height")).cast("double").alias("y1")))
    return documents.ocr_words(w)


def ocr_pages(spark, sf_dir) -> DataFrame:
    return documents.assemble(ocr_words(spark, sf_dir), keep=("conf", "rect"))


@query
def page_text_assembly(spark, sf_dir):
    """Text, words and blocks of pages from word rows."""
    p = ocr_pages(spark, sf_dir)
    line = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws("-", x["start"], x["end"])), ",")
    return p.select("doc_id", "page_text", line(F.col("words")).alias("words"), line(F.col("blocks")).alias("blocks"))


@query
def segment_offsets(spark, sf_dir):
    """Entities found block by block, at their places on the page."""
    return _entities(documents.detect_blocks(ocr_pages(spark, sf_dir), stitched=False), F.col("entities"))


def _spans_table(spark, sf_dir) -> DataFrame:
    """Texts of two addresses with a gap, or none, and their spans."""
    sql = "SELECT s_suppkey AS doc_id, '12 Hill Road' || CASE s_suppkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN chr(10) ELSE ' x ' END || '3 Palm Close' AS text, CASE s_suppkey % 3 WHEN 2 THEN 15 ELSE 13 END AS second FROM supplier"
    t = made(spark, sf_dir, sql, "supplier")
    one = lambda a, b, ord_, score: F.struct(a.alias("start"), b.alias("end"), F.lit(1).alias("src"), F.lit(ord_).alias("ord"), F.lit("ADDRESS").alias("entity_type"), F.lit(score).alias("score"), F.lit("local_context").alias("source"), spans.slice_text(F.col("text"), a, b).alias("text"))
    return t.withColumn("entities", F.array(one(F.lit(0), F.lit(12), 0, 0.5), one(F.col("second"), F.col("second") + 12, 1, 0.6)).cast(spans.SPANS))


@query
def stitched_addresses(spark, sf_dir):
    """M08."""
    t = _spans_table(spark, sf_dir)
    return _entities(t, spans.stitch(F.col("entities"), F.col("text")))


def segment_entities(spark, sf_dir) -> DataFrame:
    """Resolved entities by segment, with a place in the document's order."""
    return _entities(segments(spark, sf_dir), Detector().detect(F.col("text")), "doc_id", "seg_no")


@query
def deduped_docx_entities(spark, sf_dir):
    """Of a document's entities of one text the first."""
    e = segment_entities(spark, sf_dir).withColumnRenamed("match", "text")
    return documents.first_by_text(e, order=("seg_no", "start_at", "end_at", "entity_type")).select("doc_id", "seg_no", "start_at", "end_at", "entity_type", "score", F.col("text").alias("match"))


@query
def ocr_low_confidence(spark, sf_dir):
    """Entities with the least confidence of their words."""
    p = documents.with_confidence(documents.detect_blocks(ocr_pages(spark, sf_dir), stitched=False))
    e = p.select("doc_id", F.explode("entities").alias("e"))
    return e.select("doc_id", F.col("e.start").cast("bigint").alias("start_at"), F.col("e.end").cast("bigint").alias("end_at"), "e.entity_type", "e.ocr_confidence", "e.low_confidence")


@query
def entity_rects(spark, sf_dir):
    """A box for each word of an entity."""
    b = redact.boxes(documents.rects(documents.detect_blocks(ocr_pages(spark, sf_dir), stitched=False)))
    return b.select("doc_id", "page_num", F.col("start").cast("bigint").alias("start_at"), F.col("end").cast("bigint").alias("end_at"), "entity_type", F.col("rect.x0").alias("x0"), F.col("rect.y0").alias("y0"), F.col("rect.x1").alias("x1"), F.col("rect.y1").alias("y1"))


@query
def page_audit_counts(spark, sf_dir):
    """Entities with a box, by type, as records of pages."""
    a = redact.page_audit(documents.rects(documents.detect_blocks(ocr_pages(spark, sf_dir))))
    return audit.records(a, "pdf").groupBy("entity_type", "page_number").agg(F.count(F.lit(1)).alias("n"))


def web_pages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit(0).alias("page_num"), documents.strip_tags(F.col("html")).alias("page_text"))


@query
def page_class_counts(spark, sf_dir):
    """S07 over the texts of all web pages."""
    return web_pages(spark, sf_dir).groupBy(documents.page_class(F.col("page_text")).alias("page_class")).agg(F.count(F.lit(1)).alias("n"))


@query
def garble_class_counts(spark, sf_dir):
    """X01 over the texts of all web pages."""
    g = documents.garble_class(F.col("page_text"))
    return web_pages(spark, sf_dir).select("doc_id", g["n_chars"].alias("n_chars"), g["n_words"].alias("n_words"), F.round(g["alnum_ratio"], 6).alias("alnum_ratio"), g["garble"].alias("garble"))


def turn_pages(spark, sf_dir) -> DataFrame:
    """Turns of conversations as pages, with whether they are text, short, and without any entity."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_num"), F.col("text").alias("page_text"))
    return documents.flagged(c.withColumn("entities", Detector().detect(F.col("page_text"))))


@query
def pages_flagged(spark, sf_dir):
    """Turns of conversations that are text, short, and without an entity."""
    return turn_pages(spark, sf_dir).filter("flagged").select("doc_id", "page_num")


@query
def flagged_pages(spark, sf_dir):
    """The flagged turns of each conversation."""
    f = documents.flagged_pages(turn_pages(spark, sf_dir))
    return f.select("doc_id", F.array_join(F.transform("flagged_pages", lambda x: x.cast("string")), ",").alias("flagged_pages"))


@query
def full_texts(spark, sf_dir):
    """The turns of each conversation as one text."""
    c = table(spark, sf_dir, "conversations")
    return documents.full_text(c, key="conv_id", order="turn").select("conv_id", F.length("full_text").cast("bigint").alias("n_chars"), F.md5("full_text").alias("digest"))


@query
def file_router(spark, sf_dir):
    """File types of made-up names, unsupported ones without a type."""
    ext = "CASE s_suppkey % 6 WHEN 0 THEN '.DOCX' WHEN 1 THEN '.pdf' WHEN 2 THEN '.Tiff' WHEN 3 THEN '.jpeg' WHEN 4 THEN '.csv' ELSE '' END"
    f = made(spark, sf_dir, f"SELECT s_suppkey AS doc_id, '/in/v1.2/file' || CAST(s_suppkey AS STRING) || {ext} AS path FROM supplier", "supplier")
    return files.route(f, strict=False)


def numbered_entities(spark, sf_dir) -> DataFrame:
    """Entities of the segments, numbered by document."""
    e = segment_entities(spark, sf_dir).withColumnRenamed("match", "text")
    return documents.numbered(e, order=("seg_no", "start_at", "end_at", "entity_type", "score"))


@query
def numbered_ids(spark, sf_dir):
    """Ids from 0 in reading order."""
    return numbered_entities(spark, sf_dir).select("doc_id", "id", "seg_no", "start_at", "end_at", "entity_type", "approved")


@query
def policy_approved_counts(spark, sf_dir):
    """Entities that each policy approves, in one pass."""
    custom = {f"{review.CUSTOM}: NG_NIN, NO_SUCH_TYPE": ("NG_NIN", "NO_SUCH_TYPE"), f"{review.CUSTOM}: none": ()}
    policies = {p: review.policy_types(p) for p in review.POLICIES} | {k: review.policy_types(review.CUSTOM, v) for k, v in custom.items()} | {review.EVERYTHING: None}
    return review.policy_counts(numbered_entities(spark, sf_dir), policies)


def listed_entities(spark, sf_dir) -> DataFrame:
    """The numbered entities as decisions need them, as a table: detection is by far the most of the work, and they are read again and again."""
    return written(numbered_entities(spark, sf_dir).select("doc_id", "id", "entity_type", "approved"), "entities")


@query
def decisions_applied(spark, sf_dir):
    """Every fourth entity rejected by hand, what remains by type."""
    e = listed_entities(spark, sf_dir)
    decisions = e.filter("id % 4 = 1").select("doc_id", F.col("id").alias("entity_id"), F.lit(False).alias("approved"))
    return review.approved(review.decide(e, decisions)).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


@query
def unknown_decisions(spark, sf_dir):
    """Decisions that name no entity."""
    e = listed_entities(spark, sf_dir)
    d = e.filter("id = 0").select("doc_id", (F.col("id") + F.when(F.col("doc_id") % 7 == 0, 1000).otherwise(0)).cast("bigint").alias("entity_id"), F.lit(False).alias("approved"))
    return review.unknown_decisions(e, d).select("doc_id", "entity_id")


@query
def review_summary(spark, sf_dir):
    """Approved, rejected and ambiguous entities of each document."""
    e = review.approve_types(numbered_entities(spark, sf_dir), review.policy_types("Financial IDs only"))
    return review.summary(e)


@query
def friendly_labels(spark, sf_dir):
    """V12."""
    return numbered_entities(spark, sf_dir).select("entity_type").distinct().select("entity_type", review.friendly(F.col("entity_type")).alias("label"))


@query
def manual_add_values(spark, sf_dir):
    """A text added by hand to word processing files: once for each way it is written."""
    s = segments(spark, sf_dir)
    return review.add_by_text(s, numbered_entities(spark, sf_dir), " grace ", "PERSON_NAME").select("doc_id", "id", "text", "entity_type", "score", "source")


@query
def manual_add_occurrences(spark, sf_dir):
    """A text added by hand to pages: once for each place."""
    s = segments(spark, sf_dir).withColumnRenamed("seg_no", "page_num")
    e = numbered_entities(spark, sf_dir).withColumnRenamed("seg_no", "page_num").withColumnRenamed("start_at", "start").withColumnRenamed("end_at", "end")
    got = review.add_by_text(s, e, "Street", "ADDRESS", per_place=True)
    return got.select("doc_id", "page_num", "id", F.col("start").cast("bigint").alias("start_at"), F.col("end").cast("bigint").alias("end_at"), "text")


def redacted_segments(spark, sf_dir) -> DataFrame:
    """Segments redacted by some types, with the values that an audit needs: entities are looked for once."""
    e = review.approve_types(numbered_entities(spark, sf_dir), ("NG_NIN", "NG_BVN", "NG_TIN", "NG_NUBAN", "EMAIL_ADDRESS", "NG_PLATE"))
    s = segments(spark, sf_dir).withColumn("paragraph_index", F.col("seg_no") + 1)
    return redact.redact_segments(s, review.approved(e), keep=True)


@query
def redacted_documents(spark, sf_dir):
    """Segments with approved values replaced."""
    return redacted_segments(spark, sf_dir).select("doc_id", "seg_no", "redacted", "changed")


@query
def redaction_counts(spark, sf_dir):
    """How often each value went from each paragraph."""
    return redact.value_counts(redacted_segments(spark, sf_dir))


@query
def redaction_summary(spark, sf_dir):
    """Values matched and paragraphs changed, by document."""
    return redact.summary(redacted_segments(spark, sf_dir))


def _trail(spark, sf_dir) -> DataFrame:
    return redact.audit_trail(redacted_segments(spark, sf_dir))


@query
def audit_by_type(spark, sf_dir):
    """R05, A01, A02."""
    return audit.by_type(audit.records(_trail(spark, sf_dir), "docx"))


@query
def audit_detail(spark, sf_dir):
    """Places and confidences as they are printed."""
    return audit.detail(audit.records(_trail(spark, sf_dir), "docx")).select("doc_id", "entity_type", "place", "location", "confidence_text", "occurrence_count")


@query
def audit_totals(spark, sf_dir):
    """Counts by document and type with subtotals (an addition)."""
    return audit.type_totals(audit.records(_trail(spark, sf_dir), "docx"))


@query
def audit_report_html(spark, sf_dir):
    """The audit of each document as a page."""
    return audit.report_html(audit.records(_trail(spark, sf_dir), "docx"))


@query
def summary_lines(spark, sf_dir):
    """What was redacted, a line per value, without the value."""
    return audit.summary_lines(_trail(spark, sf_dir))


@query
def redacted_whole_documents(spark, sf_dir):
    """M06, R02 over all documents: all that is found in them replaced; digests of the texts."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    r = redact.redact_spans(d.withColumn("entities", Detector().detect(F.col("text"))))
    return r.select("doc_id", F.size("entities").cast("bigint").alias("n"), F.md5("redacted").alias("digest"))


@query
def detected_documents(spark, sf_dir):
    """V01, V02 on the merged detector: entities of whole documents, numbered in reading order."""
    e = workflow.detect_segments(segments(spark, sf_dir))
    return e.select("doc_id", "id", "seg_no", F.col("start").cast("bigint").alias("start_at"), F.col("end").cast("bigint").alias("end_at"), "entity_type", "score", "source", F.col("text").alias("match"))


def form_files(spark, sf_dir) -> DataFrame:
    """The forms as word processing files, a paragraph for each line."""
    return files.docx_files(forms(spark, sf_dir).select("doc_id", F.concat(F.lit("form"), F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"), F.split("text", "\n").alias("paragraphs")))


@query
def docx_segments_read(spark, sf_dir):
    """Paragraphs of word processing files."""
    return files.docx_segments(files.route(form_files(spark, sf_dir))).select("doc_id", "path", "part", F.col("seg_no").cast("bigint").alias("seg_no"), F.col("paragraph_index").cast("bigint").alias("paragraph_index"), "text")


@query
def redacted_files(spark, sf_dir):
    """Files with all that is found in them replaced, read again."""
    out, _ = workflow.redact_document(form_files(spark, sf_dir))
    return files.docx_segments(out).select("doc_id", F.col("paragraph_index").cast("bigint").alias("paragraph_index"), "text")


@query
def detections_side_by_side(spark, sf_dir):
    """What each source found in each form, and what was resolved."""
    d = documents.side_by_side(forms(spark, sf_dir), Detector(deny=DENY))
    line = lambda c: F.array_join(F.array_sort(F.transform(c, lambda x: F.format_string("%06d-%06d:%s", x["start"], x["end"], x["entity_type"]))), ",").alias(c)
    return d.select("doc_id", line("by_pattern"), line("by_context"), line("merged"))


@query
def ocr_entity_dump(spark, sf_dir):
    """Entities of scanned pages with their words and confidences."""
    e = documents.words_of_entities(documents.detect_blocks(ocr_pages(spark, sf_dir), stitched=False))
    return e.select("doc_id", F.col("start").cast("bigint").alias("start_at"), "entity_type", "text", "shown")


@query
def page_overlay(spark, sf_dir):
    """Boxes on pages with their colours: names rejected, places added by hand, the rest approved."""
    r = documents.rects(documents.detect_blocks(ocr_pages(spark, sf_dir), stitched=False))
    r = r.withColumn("approved", F.col("entity_type") != "PERSON_NAME").withColumn("source", F.when(F.col("entity_type") == "STATE_OF_ORIGIN", "manual").otherwise(F.col("source")))
    b = redact.overlay(r)
    return b.select("doc_id", F.col("start").cast("bigint").alias("start_at"), "entity_type", "colour", F.col("rect.x0").alias("x0"), F.col("rect.y0").alias("y0"))


@query
def preview_html(spark, sf_dir):
    """Segments as HTML with marked values."""
    e = review.approve_types(numbered_entities(spark, sf_dir), ("NG_NIN", "NG_TIN"))
    return redact.preview(segments(spark, sf_dir), e).select("doc_id", "seg_no", "html")


def _runs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two runs over the forms: identifiers known, some of them redacted, and some words too many. Each form is scored by itself."""
    f = forms(spark, sf_dir).withColumn("run", F.concat(F.lit("run"), (F.col("doc_id") % 2).cast("string")))
    known = F.array(F.split_part("text", F.lit("\n"), F.lit(2)), F.split_part("text", F.lit("\n"), F.lit(11)))
    truth = f.select("run", "doc_id", F.explode(F.transform(known, lambda x: F.struct(F.split_part(x, F.lit(" "), F.lit(1)).alias("type"), F.element_at(F.split(x, " "), -1).alias("item")))).alias("t")).select("run", "doc_id", "t.*")
    red = F.regexp_replace(F.regexp_replace("text", "(NIN: )[0-9]+", "$1[REDACTED]"), "(Licence )[A-Z0-9]+", "$1[REDACTED]")
    return truth, f.select("run", "doc_id", F.col("text").alias("original"), red.alias("redacted"))


@query
def eval_item_recall(spark, sf_dir):
    """E01, E03, E04."""
    return evaluate.item_recall(*_runs(spark, sf_dir), lists=False)


@query
def eval_leaked_items(spark, sf_dir):
    """The known items that are left, by document."""
    return evaluate.item_hits(*_runs(spark, sf_dir)).filter("left").select("run", "doc_id", "type", "item")


@query
def eval_word_prf(spark, sf_dir):
    """E02, E05, E06."""
    r = evaluate.word_scores(*_runs(spark, sf_dir), lists=False)
    return r.select("run", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query
def eval_collateral(spark, sf_dir):
    """Removed words that no known item has, by document, with how often."""
    return evaluate.word_hits(*_runs(spark, sf_dir)).filter("fp > 0").select("run", "doc_id", "word", F.col("fp").alias("n"))


@query
def eval_report(spark, sf_dir):
    """E07."""
    return evaluate.report(*_runs(spark, sf_dir), lists=False).select("run", "tp", "fp", "fn", "items_ok", "items_total", "per_type")


def conll(spark, sf_dir) -> DataFrame:
    return made(spark, sf_dir, corpus.conll_sql(), "supplier")


@query
def conll_spans(spark, sf_dir):
    """B01."""
    return name_lists.person_spans(conll(spark, sf_dir))


@query
def gazetteer_build(spark, sf_dir):
    """B02 to B04."""
    return name_lists.build(name_lists.person_spans(conll(spark, sf_dir)))


@query
def error_kinds(spark, sf_dir):
    """V13."""
    m = made(spark, sf_dir, "SELECT s_suppkey AS doc_id, CASE s_suppkey % 4 WHEN 0 THEN 'File is Encrypted' WHEN 1 THEN 'Bad ZIP file' WHEN 2 THEN 'timeout' END AS message FROM supplier", "supplier")
    return m.select("doc_id", review.error_kind(F.col("message")).alias("kind"))


@query
def manifest_rows(spark, sf_dir):
    """Manifests of each document, to JSON and back."""
    e = numbered_entities(spark, sf_dir).withColumnRenamed("start_at", "s").withColumnRenamed("end_at", "t").withColumn("start", F.col("s").cast("int")).withColumn("end", F.col("t").cast("int"))
    m = files.manifest(e.withColumn("path", F.concat(F.lit("d"), F.col("doc_id").cast("string"))).withColumn("file_type", F.lit("docx")).withColumn("created_at", F.lit("2024-01-01")))
    back = m.select(F.from_json(F.to_json(F.struct(*m.columns)), files.MANIFEST).alias("m")).select("m.*")
    return back.select("input_path", "file_type", F.size("spans").cast("bigint").alias("n_spans"), F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["id"], x["entity_type"], x["location"]["start"])), ",").alias("ids"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms redacted by their resolved entities, with how many there were."""
    f = forms(spark, sf_dir).withColumn("entities", Detector(deny=DENY).detect(F.col("text")))
    return redact.redact_spans(f).select("doc_id", "redacted", F.size("entities").cast("bigint").alias("n_entities"))

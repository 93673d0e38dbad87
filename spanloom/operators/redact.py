"""Redaction: where approved values stand in a segment, its new text, counts and previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import spans

LABEL = "[REDACTED]"
CLAIM = "array<struct<start:int,end:int,value:string>>"
# Colours of a preview.
APPROVED, REJECTED, MANUAL = "rgba(231, 76, 60, 0.35)", "rgba(149, 165, 166, 0.30)", "rgba(155, 89, 182, 0.40)"


def _places_of(text: Column, value: Column) -> Column:
    """Left to right, where a value starts, each time not overlapping the one before."""
    gaps = F.split(text, F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")), -1)
    ends = spans.running(F.transform(F.slice(gaps, F.lit(1), F.size(gaps) - 1), lambda gap: F.length(gap) + F.length(value)), lambda a, b: a + b)
    return F.transform(ends, lambda end: end - F.length(value))


def claims(text: Column, values: Column) -> Column:
    """Places of values (array<string>, in order) in a text: longer values first, then earlier ones; a place that overlaps a claimed one is passed over."""
    ranked = F.sort_array(F.transform(F.filter(values, lambda v: F.coalesce(F.length(v), F.lit(0)) > 0), lambda v, i: F.struct((-F.length(v)).alias("k"), i.alias("i"), v.alias("v"))))
    held = F.filter(F.transform(ranked, lambda x: x["v"]), lambda v: F.contains(text, v))
    place = lambda start, v, k: F.struct(start.alias("start"), (start + F.length(v)).alias("end"), k.alias("rank"), v.alias("value"))
    found = F.flatten(F.transform(held, lambda v, k: F.transform(_places_of(text, v), lambda start: place(start, v, k))))

    def one(acc: Column, c: Column) -> Column:
        return F.when(F.exists(acc, lambda a: (a["start"] < c["end"]) & (c["start"] < a["end"])), acc).otherwise(F.concat(acc, F.array(c)))

    def greedy(c: Column) -> Column:  # places of one cluster, by rank
        order = F.sort_array(F.transform(c, lambda x: F.struct(x["rank"].alias("rank"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"))))
        return F.sort_array(F.aggregate(F.transform(order, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"))), F.array().cast(CLAIM), one))

    runs = spans.clusters(F.sort_array(found), "array<struct<start:int,end:int,rank:int,value:string>>")
    return F.flatten(F.transform(runs, greedy))


def rewrite(text: Column, places: Column, label: Column | str = LABEL) -> Column:
    """The text with a label at each place, by start; a place that starts before the last one ended, or lies beyond the text, is passed over or cut."""
    mark = label if isinstance(label, Column) else F.lit(label)
    return spans.replaced(text, spans.apart(places, text), lambda p: mark)


def redact_segments(segments: DataFrame, approved: DataFrame, *, key: str = "doc_id", text: str = "text", order: tuple[str, ...] = ("id",), label: str = LABEL, keep: bool = False) -> DataFrame:
    """The segments with redacted text, claims and changed (whether the text is another one; a value that is the label changes nothing).

    A document's distinct approved values come to its segments as one list, so segments meet their
    own document's values only and no pair of segment and value is made outside a row. They are as many
    as the documents, whatever size Spark makes of a plan's start, so they are never broadcast. keep: the
    list stays as `values`, with each value's last entity, so that an audit needs no second look at
    the entities.
    """
    known = [F.struct(*order).alias("o"), F.struct("entity_type", "score", "source").alias("e")] if keep else [F.struct(*order).alias("o")]
    some = approved.filter(F.coalesce(F.col("text"), F.lit("")) != "").select(key, F.col("text").alias("v"), *known)
    first = some.groupBy(key, "v").agg(F.min("o").alias("o"), *([F.max_by("e", "o").alias("e")] if keep else []))
    fields = ("v", "e") if keep else ("v",)
    values = first.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("o", *fields))), lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("values"))
    t = F.coalesce(F.col(text), F.lit(""))
    out = segments.join(values.hint("merge"), key, "left").withColumn("claims", F.when(F.col("values").isNull(), F.array().cast(CLAIM)).otherwise(claims(t, F.transform("values", lambda x: x["v"]))))
    out = out.withColumn("redacted", F.when(F.size("claims") > 0, rewrite(t, F.col("claims"), label)).otherwise(F.col(text)))
    out = out.withColumn("changed", (F.size("claims") > 0) & (F.col("redacted") != t))
    return out if keep else out.drop("values")


def redact_spans(rows: DataFrame, *, text: str = "text", entities: str = "entities", label: str = LABEL) -> DataFrame:
    """Text with each entity's place replaced, for rows that hold their entities."""
    return rows.withColumn("redacted", rewrite(F.coalesce(F.col(text), F.lit("")), F.col(entities), label))


def value_counts(redacted: DataFrame, *, key: str = "doc_id", para: str = "paragraph_index") -> DataFrame:
    """How often each value went from each paragraph."""
    return redacted.select(key, para, F.explode("claims").alias("c")).groupBy(key, para, F.col("c.value").alias("text")).agg(F.count(F.lit(1)).alias("n"))


def audit_trail(redacted: DataFrame, approved: DataFrame | None = None, *, key: str = "doc_id", para: str = "paragraph_index") -> DataFrame:
    """A row per redacted value: its last entity's type, score and source, paragraphs in order with repeats, and how often.

    The entities are those that redact_segments() kept, or else approved.
    """
    sums = [F.sort_array(F.collect_list(para)).alias("paragraph_indices"), F.count(F.lit(1)).alias("occurrence_count")]
    if approved is None:
        each = F.transform("claims", lambda c: F.struct(c["value"].alias("text"), F.get(F.filter("values", lambda x: x["v"] == c["value"]), F.lit(0))["e"].alias("e")))
        hits = redacted.select(key, para, F.explode(each).alias("c")).groupBy(key, F.col("c.text").alias("text")).agg(F.first("c.e").alias("e"), *sums)
    else:
        hits = redacted.select(key, para, F.explode("claims").alias("c")).groupBy(key, F.col("c.value").alias("text")).agg(*sums)
        hits = hits.join(approved.groupBy(key, "text").agg(F.max_by(F.struct("entity_type", "score", "source"), "id").alias("e")), [key, "text"])
    return hits.select(key, "text", "e.entity_type", "e.score", "e.source", "paragraph_indices", "occurrence_count")


def summary(redacted: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Distinct values matched and paragraphs changed, by document."""
    one = redacted.groupBy(key).agg(F.count_if("changed").alias("paragraphs_redacted"), F.array_distinct(F.flatten(F.collect_list(F.transform("claims", lambda c: c["value"])))).alias("v"))
    return one.select(key, F.size("v").cast("long").alias("entities_matched"), "paragraphs_redacted")


def boxes(entity_rects: DataFrame) -> DataFrame:
    """A row per box to cover."""
    return entity_rects.select(*[c for c in entity_rects.columns if c != "rects"], F.explode("rects").alias("rect"))


def page_audit(entity_rects: DataFrame) -> DataFrame:
    """Entities with a box, without their text."""
    return entity_rects.filter(F.size("rects") > 0).select("doc_id", "page_num", "entity_type", "score", "source")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def colour(is_approved: Column, is_manual: Column) -> Column:
    """Approved before manual before rejected."""
    return F.when(is_approved, APPROVED).when(is_manual, MANUAL).otherwise(REJECTED)


def overlay_colour(is_approved: Column, source: Column) -> Column:
    """On pages manual before approved before rejected."""
    return F.when(source == "manual", F.lit("manual")).when(is_approved, "approved").otherwise("rejected")


def overlay(entity_rects: DataFrame) -> DataFrame:
    """A row per box to draw on a page, with its colour by source and approval."""
    return boxes(entity_rects.withColumn("colour", overlay_colour(F.coalesce(F.col("approved"), F.lit(True)), F.col("source"))))


def preview(segments: DataFrame, entities: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each segment as a paragraph of HTML with the entities' values marked by status; blank segments go."""
    status = entities.filter(F.coalesce(F.col("text"), F.lit("")) != "").groupBy(key, F.col("text").alias("v")).agg(F.bool_or(F.coalesce(F.col("approved"), F.lit(False))).alias("a"), F.bool_or(F.col("source") == "manual").alias("m"), F.min("id").alias("o"))
    by = status.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("o", "v", colour(F.col("a"), F.col("m")).alias("c")))).alias("__s"))
    t = F.coalesce(F.col(text), F.lit(""))
    s = F.coalesce(F.col("__s"), F.array().cast("array<struct<o:bigint,v:string,c:string>>"))
    tone = lambda p: F.get(F.filter(s, lambda x: x["v"] == p["value"]), F.lit(0))["c"]
    mark = lambda p: F.concat(F.lit('<mark style="background-color:'), tone(p), F.lit('; padding:1px 2px; border-radius:3px;">'), escaped(p["value"]), F.lit("</mark>"))
    out = segments.filter(t.rlike(r"(?U)\S")).join(by, key, "left")
    html = spans.replaced(t, claims(t, F.transform(s, lambda x: x["v"])), mark, escaped)
    return out.withColumn("html", F.concat(F.lit("<p>"), html, F.lit("</p>"))).drop("__s")

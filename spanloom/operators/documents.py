"""Pages and segments: assembly of words, classes of pages, detection by segment, confidences, deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import detect as d, spans

#: Pages with fewer characters are scans; text pages without an entity and with fewer than this are flagged; confidences under this are low.
SCAN_CHARS, THIN_CHARS, LOW_CONFIDENCE = 15, 100, 60
_bare = lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def page_class(text: Column) -> Column:
    """Scanned or text."""
    return F.when(F.length(_bare(F.coalesce(text, F.lit("")))) < SCAN_CHARS, F.lit("scanned")).otherwise(F.lit("text"))


def garble_class(text: Column) -> dict[str, Column]:
    """Characters, words, share of letters and digits among what isn't space, and the class."""
    t = F.coalesce(text, F.lit(""))
    solid = F.regexp_replace(t, r"(?U)\s", "")
    ratio = F.when(F.length(solid) > 0, F.length(F.regexp_replace(solid, r"[^\p{L}\p{N}]", "")) / F.length(solid)).otherwise(F.lit(0.0))
    words = F.size(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != ""))
    chars = F.length(_bare(t))
    kind = F.when(chars == 0, "no text").when((ratio < 0.5) | (words < 3), "garbled").otherwise("normal")
    return {"n_chars": chars.cast("long"), "n_words": words.cast("long"), "alnum_ratio": ratio, "garble": kind}


def ocr_words(words: DataFrame) -> DataFrame:
    """Word rows (level 5) that have text and a confidence."""
    return words.filter((F.col("level") == 5) & (F.col("conf") >= 0) & (_bare(F.col("text")) != "")).withColumn("text", _bare(F.col("text")))


def assemble(words: DataFrame, *, keys: Sequence[str] = ("doc_id", "page_num"), block: str = "block_num", line: str = "line_num", order: Sequence[str] = ("block_num", "line_num", "word_num"), word: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """A page's text and its words' places, and the places of its blocks.

    Words are put in order; a new block or line starts with a line end, other words with a space.
    A block but the first starts at the separator before its first word. One row per page: keys,
    page_text, words array<struct<start,end,text,keep...>>, blocks array<struct<start,end>>. Each
    page is one row already when its words are gathered, so the order is made row by row.
    """
    fields = [*order, word, *keep]
    rows = words.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*[F.col(f).alias(f"k{i}") if f in order else F.col(f).alias(f) for i, f in enumerate(fields)]))).alias("w"))
    at = {f: f"k{i}" for i, f in enumerate(fields) if f in order}
    wname = at.get(word, word)
    kind = "array<struct<start:int,end:int,text:string,first:boolean" + "".join(f",{k}:{words.schema[k].dataType.simpleString()}" for k in keep) + ">>"
    zero = F.struct(F.lit(0).alias("at"), F.lit(None).cast(words.schema[block].dataType).alias("b"), F.lit(None).cast(words.schema[line].dataType).alias("l"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        first = F.size(acc["out"]) == 0
        start = F.when(first, F.lit(0)).otherwise(acc["at"] + 1)
        new = first | ~acc["b"].eqNullSafe(x[at[block]])
        one = F.struct(start.alias("start"), (start + F.length(x[wname])).alias("end"), x[wname].alias("text"), new.alias("first"), *[x[k].alias(k) for k in keep])
        return F.struct((start + F.length(x[wname])).alias("at"), x[at[block]].alias("b"), x[at[line]].alias("l"), F.concat(acc["out"], F.array(one).cast(kind)).alias("out"))

    def text(w: Column) -> Column:
        parts = F.transform(w, lambda x, i: F.concat(F.when(i == 0, F.lit("")).when(x[at[block]].eqNullSafe(F.get(w, i - 1)[at[block]]) & x[at[line]].eqNullSafe(F.get(w, i - 1)[at[line]]), F.lit(" ")).otherwise(F.lit("\n")), x[wname]))
        return F.array_join(parts, "")

    out = rows.select(*keys, text(F.col("w")).alias("page_text"), F.aggregate("w", zero, step)["out"].alias("words"))
    begins = F.transform(F.filter("words", lambda x: x["first"]), lambda x: F.greatest(x["start"] - 1, F.lit(0)))
    edges = F.concat(begins, F.array(F.length("page_text")))
    return out.withColumn("blocks", F.transform(begins, lambda b, i: F.struct(b.alias("start"), F.get(edges, i + 1).alias("end"))))


def detect_blocks(pages: DataFrame, detector: d.Detector | None = None, *, text: str = "page_text", blocks: str = "blocks", stitched: bool = True) -> DataFrame:
    """The page rows with entities: each block is searched by itself, places are the page's; pages of PDFs have addresses stitched."""
    t = F.coalesce(F.col(text), F.lit(""))
    find = (detector or d.Detector()).detect
    found = F.flatten(F.transform(blocks, lambda b: spans.shift(find(spans.slice_text(t, b["start"], b["end"])), b["start"])))
    return pages.withColumn("entities", spans.stitch(found, t) if stitched else F.sort_array(found))


def with_confidence(pages: DataFrame, *, entities: str = "entities", words: str = "words", conf: str = "conf") -> DataFrame:
    """Each entity with the least confidence of the words it overlaps; low under the limit or without a word."""
    least = lambda e: F.array_min(F.transform(F.filter(words, lambda w: spans.overlaps(w, e)), lambda w: w[conf]))
    return pages.withColumn(entities, F.transform(entities, lambda e: F.struct(*[e[c].alias(c) for c in ("start", "end", "entity_type", "score", "source", "text")], least(e).alias("ocr_confidence"), F.coalesce(least(e) < LOW_CONFIDENCE, F.lit(True)).alias("low_confidence"))))


def flagged(pages: DataFrame, *, text: str = "page_text", entities: str = "entities") -> DataFrame:
    """Text pages without an entity and with little text."""
    return pages.withColumn("flagged", (page_class(F.col(text)) == "text") & (F.size(entities) == 0) & (F.length(text) < THIN_CHARS))


def flagged_pages(pages: DataFrame, *, key: str = "doc_id", page: str = "page_num") -> DataFrame:
    """The numbers of a document's flagged pages in order (none: an empty list)."""
    return pages.groupBy(key).agg(F.sort_array(F.collect_list(F.when(F.col("flagged"), F.col(page)))).alias("flagged_pages"))


def exploded(rows: DataFrame, *, entities: str = "entities") -> DataFrame:
    """A row per entity, numbered within its row (pos)."""
    return rows.select(*[c for c in rows.columns if c != entities], F.posexplode(entities).alias("pos", "e")).select("*", "e.*").drop("e")


def first_by_text(entities: DataFrame, *, key: str = "doc_id", text: str = "text", order: Sequence[str] = ("seg_no", "start")) -> DataFrame:
    """Of a document's entities of one text the first; empty texts go. The least row wins by a sum made before the shuffle, not by a window."""
    rest = [c for c in entities.columns if c not in (key, text)]
    first = entities.filter(F.coalesce(F.col(text), F.lit("")) != "").groupBy(key, text).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return first.select(key, text, "r.*").select(*entities.columns)


def numbered(entities: DataFrame, *, key: str = "doc_id", order: Sequence[str] = ("page_num", "start")) -> DataFrame:
    """Entities with an id from 0 within their document, all approved."""
    w = W.partitionBy(key).orderBy(*order)
    return entities.withColumn("id", (F.row_number().over(w) - 1).cast("long")).withColumn("approved", F.lit(True))


def full_text(segments: DataFrame, *, key: str = "doc_id", order: str = "seg_no", text: str = "text") -> DataFrame:
    """A document's segments joined by line ends, in order."""
    return segments.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n").alias("full_text"))


def rects(pages: DataFrame, *, entities: str = "entities", words: str = "words", rect: str = "rect") -> DataFrame:
    """A row per entity with the boxes of the words it overlaps, one box a word."""
    return exploded(pages.withColumn(entities, F.transform(entities, lambda e: F.struct(*[e[c].alias(c) for c in ("start", "end", "entity_type", "score", "source", "text")], F.transform(F.filter(words, lambda w: spans.overlaps(w, e)), lambda w: w[rect]).alias("rects")))), entities=entities)


def side_by_side(texts: DataFrame, detector: d.Detector | None = None, *, text: str = "text") -> DataFrame:
    """The rows with what each source found, and what was resolved, as arrays of spans by place."""
    look, t = detector or d.Detector(), F.coalesce(F.col(text), F.lit(""))
    return texts.withColumns({"by_pattern": F.sort_array(look.pattern(t)), "by_context": F.sort_array(look.context(t)), "merged": look.detect(t)})


def words_of_entities(pages: DataFrame, *, entities: str = "entities", words: str = "words") -> DataFrame:
    """A row per entity of a page with its words and their confidences, as they are printed."""
    shown = lambda e: F.array_join(F.transform(F.filter(words, lambda w: spans.overlaps(w, e)), lambda w: F.concat(w["text"], F.lit("("), F.round(w["conf"]).cast("int").cast("string"), F.lit(")"))), " ")
    fields = ("start", "end", "entity_type", "score", "source", "text")
    return exploded(pages.select("doc_id", "page_num", F.transform(entities, lambda e: F.struct(*[e[c].alias(c) for c in fields], shown(e).alias("shown"))).alias(entities)), entities=entities)


def strip_tags(html: Column) -> Column:
    """Text of a web page: scripts, styles and tags gone, a line end for each block."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?i)</?(?:p|div|li|h[1-6]|br|tr|article|nav|ul|ol|table)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "&lt;", "<"), "&gt;", ">"), "&amp;", "&")

"""Name lists from tagged text: spans of persons, cleaning, plain spellings."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import StringType

LEAST_CHARS = 4
# Words that are no names.
STOP_WORDS = (
    "the", "and", "for", "are", "was", "were", "with", "from", "this", "that", "have", "has", "had", "not", "but", "you", "your", "our",
    "his", "her", "its", "who", "what", "when", "where", "why", "how",
    "ohio", "georgia", "montana", "israel", "chile", "guinea", "caribbean",
    "advocate", "commentator", "language", "court", "grange", "possibility", "rainbow", "macaroni", "fabulous", "witty", "skinny",
    "slows", "sale", "fall", "west", "east", "north", "south", "bush", "gold", "long", "blue", "easy", "iron", "lady", "lone", "black",
    "white",
)


def person_spans(lines: DataFrame, *, file: str = "file", order: str = "line_no", line: str = "line") -> DataFrame:
    """Distinct person spans of each file. B-PER starts one, I-PER goes on, any other tag ends it; blank lines and lines that aren't a token and a tag are passed over."""
    parts = F.split(F.trim(F.regexp_replace(line, r"(?U)\s+", " ")), " ")
    rows = lines.select(file, order, parts.alias("p")).filter((F.size("p") == 2) & (F.get("p", F.lit(0)) != "")).select(file, order, F.get("p", F.lit(0)).alias("token"), F.get("p", F.lit(1)).alias("tag"))
    w = W.partitionBy(file).orderBy(order)
    # an edge is any row that isn't a continuation; a span is an edge of B-PER with the continuations up to the next edge
    run = rows.withColumn("run", F.sum((F.col("tag") != "I-PER").cast("int")).over(w))
    spans = run.groupBy(file, "run").agg(F.sort_array(F.collect_list(F.struct(order, "token", "tag"))).alias("t"))
    return spans.filter(F.get("t", F.lit(0))["tag"] == "B-PER").select(file, F.array_join(F.transform("t", lambda x: x["token"]), " ").alias("span")).distinct()


def tidy(span: Column) -> Column:
    """Hyphens without spaces, no marks at the ends."""
    return F.trim(F.regexp_replace(span, r"(?U)\s*-\s*", "-"), F.lit(" .,;:'\"()-"))


def acceptable(cleaned: Column, least: Column | int) -> Column:
    """Long enough, with a letter, and no stop word."""
    return (F.length(cleaned) >= least) & cleaned.rlike(r"\p{L}") & ~F.lower(cleaned).isin(*STOP_WORDS)


@F.pandas_udf(StringType())
def strip_marks(s: pd.Series) -> pd.Series:
    """Letters without their marks. SQL has no decomposition of characters, so this one runs in Python, over Arrow batches."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn"))


def build(spans: DataFrame, *, column: str = "span") -> DataFrame:
    """Names: whole spans (single words of LEAST_CHARS letters or more) and their words, each also without marks; distinct, in order."""
    tidied = spans.select(tidy(F.col(column)).alias("name")).filter(F.col("name").rlike(r"\p{L}"))
    whole = tidied.filter(acceptable(F.col("name"), F.when(F.contains("name", F.lit(" ")), F.lit(1)).otherwise(F.lit(LEAST_CHARS))))
    tokens = whole.select(F.explode(F.split("name", r"(?U)\s+")).alias("name")).select(tidy(F.col("name")).alias("name")).filter(acceptable(F.col("name"), LEAST_CHARS))
    both = whole.unionByName(tokens).distinct()
    return both.unionByName(both.select(strip_marks("name").alias("name"))).distinct().orderBy("name")

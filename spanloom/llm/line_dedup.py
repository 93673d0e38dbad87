"""Line dedup: drop the lines that stand in many documents. DataFrame functions only.

Lines are exploded with their positions and normalised to a key, of which only a 128-bit hash is
shuffled. Distinct documents are counted for each hash in two steps (by hash and document first, so
a line of a third of all documents is spread), the positions of lines over the threshold come back
to their document (those of the most frequent lines by broadcast), and what stands between these
positions is joined again in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import join_on, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space (space, U+0009 to U+000D) at its ends, A to Z in lower case."""
    bare = F.trim(line, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def drop_common_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, counts: tuple[str, str] | None = None) -> DataFrame:
    """The rows with their common lines gone from text_col, all other columns as they were.

    A line goes if its key has at least min_chars code points and is found in at least min_docs
    documents; it goes from all of them, each time it stands there. A null or empty text is one
    empty line and becomes an empty text. A document is a distinct pair of id and text: repeated
    rows count once and are treated alike, and a null id is an id. Lines are ordered as they were.
    counts names two more columns for the numbers of lines and of dropped lines (they take the
    place of columns with those names). An empty table gives no rows.
    """
    known = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id")).withColumn("at", F.xxhash64(F.coalesce(F.col("row").getField(text_col), F.lit(""))))
    exploded = known.select("id", "at", F.posexplode(_lines(F.col("row").getField(text_col))).alias("pos", "line")).select("id", "at", "pos", line_key(F.col("line")).alias("key"))
    lines = written(exploded.filter(F.char_length("key") >= min_chars).select("id", "at", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(7), F.col("key")).alias("g")), "lines")
    common = lines.select("h", "g", "id", "at").distinct().groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs).select("h", "g")
    gone = join_on(lines, written(common, "common"), ["h", "g"], "left_semi").groupBy("id", "at").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    k, g = known.alias("k"), gone.alias("g")
    both = k.join(g, F.col("k.id").eqNullSafe(F.col("g.id")) & (F.col("k.at") == F.col("g.at")), "left")
    both = both.select("row", F.coalesce(F.col("row").getField(text_col), F.lit("")).alias("text"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    both = both.withColumn("lines", _lines(F.col("text"))).withColumn("edges", F.concat(F.array(F.lit(-1)), "gone", F.array(F.size("lines"))))
    between = F.transform(F.sequence(F.lit(1), F.size("edges") - 1), lambda j: F.slice("lines", F.get("edges", j - 1) + 2, F.get("edges", j) - F.get("edges", j - 1) - 1))
    kept = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(F.flatten(between), "\n"))
    extra = {} if counts is None else {counts[0]: F.size("lines").cast("long"), counts[1]: F.size("gone").cast("long")}
    columns = [kept.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c not in extra]
    return both.select(*columns, *[v.alias(c) for c, v in extra.items()])

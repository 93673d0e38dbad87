"""Scores of a redaction against known items and against the words of the original."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .redact import LABEL


def norm(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def words(text: Column) -> Column:
    """Words without marks at their ends; empty ones and labels go."""
    return F.filter(F.transform(F.split(norm(text), " "), lambda w: F.trim(w, F.lit(".,;:()\"'"))), lambda w: (w != "") & (w != LABEL))


def present(item: Column, text: Column) -> Column:
    """Whether an item, normalised, stands in a normalised text, with no word character or hyphen at its ends."""
    quoted = F.concat(F.lit(r"(?U)(?<![\w-])\Q"), F.replace(norm(item), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![\w-])"))
    return F.contains(text, norm(item)) & F.regexp_like(text, quoted)


def _by(texts: DataFrame) -> list[str]:
    """A run's texts are scored document by document where they have a doc_id; else a run is one text."""
    return ["run", "doc_id"] if "doc_id" in texts.columns else ["run"]


def item_hits(truth: DataFrame, texts: DataFrame) -> DataFrame:
    """Each known item (run, type, item) of a document and whether it is left in that document's redacted text."""
    by = _by(texts)
    t = texts.select(*by, norm(F.col("redacted")).alias("__text"))
    return truth.join(t, by).withColumn("left", present(F.col("item"), F.col("__text"))).drop("__text")


def item_recall(truth: DataFrame, texts: DataFrame, *, lists: bool = True) -> DataFrame:
    """By run and type, items gone and items in all; with lists also the items left, in order (for small runs: else take item_hits())."""
    sums = [F.count_if(~F.col("left")).alias("items_ok"), F.count(F.lit(1)).alias("items_total")]
    more = [F.sort_array(F.collect_list(F.when(F.col("left"), F.col("item")))).alias("leaked")] if lists else []
    return item_hits(truth, texts).groupBy("run", "type").agg(*sums, *more)


def _bag(rows: DataFrame, by: list[str], text: str, name: str) -> DataFrame:
    return rows.select(*by, F.explode(words(F.col(text))).alias("word")).groupBy(*by, "word").agg(F.count(F.lit(1)).alias(name))


def word_hits(truth: DataFrame, texts: DataFrame) -> DataFrame:
    """By document and word, as multisets: tp (removed, of a known item), fp (removed, of none) and fn (of a known item, not removed)."""
    by = _by(texts)
    before, after = _bag(texts, by, "original", "a"), _bag(texts, by, "redacted", "b")
    gold = _bag(truth.withColumnRenamed("item", "text"), by, "text", "g")
    both = before.join(after, [*by, "word"], "full").join(gold, [*by, "word"], "full").fillna(0, ["a", "b", "g"])
    gone = both.withColumn("r", F.greatest(F.col("a") - F.col("b"), F.lit(0)))
    return gone.select(*by, "word", F.least("r", "g").alias("tp"), F.greatest(F.col("r") - F.col("g"), F.lit(0)).alias("fp"), F.greatest(F.col("g") - F.col("r"), F.lit(0)).alias("fn"))


def word_scores(truth: DataFrame, texts: DataFrame, *, lists: bool = True) -> DataFrame:
    """By run the sums over its documents, precision, recall, F1 (0 where undefined); with lists also the removed words that no item has, with repeats (for small runs: else take word_hits())."""
    more = [F.sort_array(F.flatten(F.collect_list(F.array_repeat("word", F.col("fp").cast("int"))))).alias("collateral")] if lists else []
    sums = word_hits(truth, texts).groupBy("run").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), *more)
    share = lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(0.0))
    out = sums.join(texts.select("run").distinct(), "run", "right").fillna(0, ["tp", "fp", "fn"])
    out = out.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def report(truth: DataFrame, texts: DataFrame, *, lists: bool = True) -> DataFrame:
    """A row per run with all figures, the types as JSON."""
    types = F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", F.struct("items_ok", "items_total")))))).alias("per_type")
    more = [F.sort_array(F.flatten(F.collect_list("leaked"))).alias("leaked")] if lists else []
    items = item_recall(truth, texts, lists=lists).groupBy("run").agg(F.sum("items_ok").alias("items_ok"), F.sum("items_total").alias("items_total"), types, *more)
    return word_scores(truth, texts, lists=lists).join(items, "run", "left")

"""Gazetteers and name lists from JSON, and to JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import spans
from ..functions.detect import Detector
from ..functions.places import Gazetteer

#: Terms that a pattern may be built from; longer lists are joined instead.
MOST_TERMS = 20_000


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Lga, state and ord, the place of the area in the file, from {states: [...], lgas_by_state: {state: [...]}}."""
    raw = spark.read.option("multiLine", "true").schema("states array<string>, lgas_by_state map<string,array<string>>").json(path)
    one = raw.select(F.posexplode(F.map_entries("lgas_by_state")).alias("i", "e")).select("i", "e.key", F.posexplode("e.value").alias("j", "lga"))
    return one.select("lga", F.col("key").alias("state"), (F.col("i") * 10_000 + F.col("j")).cast("bigint").alias("ord"))


def gazetteer(spark: SparkSession, path: str) -> Gazetteer:
    """The terms of a gazetteer file for patterns. It is a list of places, so it is held to MOST_TERMS."""
    rows = read_gazetteer(spark, path).orderBy("ord").limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} areas: join them as a table instead")
    return Gazetteer(lgas=tuple((r["lga"], r["state"]) for r in rows))


def detector(spark: SparkSession, path: str, **options) -> Detector:
    """A detector that knows the areas of a gazetteer file."""
    return Detector(gazetteer=gazetteer(spark, path), **options)


def state_of(areas: DataFrame) -> DataFrame:
    """Each area's state; of an area in several the last one."""
    return areas.groupBy("lga").agg(F.max_by("state", "ord").alias("state"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """A row per name, of files that are a JSON list or, as write_names() makes them, a JSON line for each name."""
    text = spark.read.text(path, wholetext=True)
    lines = F.transform(F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != ""), lambda x: F.get_json_object(x, "$.name"))
    names = F.when(F.col("value").rlike(r"^\s*\["), F.from_json("value", "array<string>")).otherwise(lines)
    return text.select(F.explode(names).alias("name")).filter("name IS NOT NULL")


def listed_names(texts: DataFrame, names: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """D15 for lists too long for a pattern: word sequences joined with the names, in any case; of those that start at a place the longest."""
    most_words = max(1, names.agg(F.max(F.size(F.split("name", " ")))).first()[0] or 1)
    parts = F.split(F.regexp_replace(text, r"(?U)[^\w'’-]", " "), " ")

    def grams(w: Column) -> Column:  # each word's place, and the sequences that start there
        upto = lambda i: F.sequence(F.lit(1), F.least(F.lit(most_words), F.size(w) - i))
        one = lambda end, i: F.transform(upto(i), lambda n: F.struct((end - F.length(F.get(w, i)) - 1).alias("start"), n.alias("n"), F.array_join(F.slice(w, i + 1, n), " ").alias("text")))
        ends = spans.running(F.transform(w, lambda x: F.length(x) + 1), lambda a, b: a + b)
        return F.flatten(F.transform(ends, lambda end, i: F.when(F.get(w, i) != "", one(end, i)).otherwise(F.array().cast("array<struct<start:int,n:int,text:string>>"))))

    found = texts.select(key, F.explode(spans.let(parts, grams)).alias("g")).select(key, "g.*")
    hits = found.join(names.select(F.lower("name").alias("k")).distinct(), F.lower("text") == F.col("k"), "left_semi")
    best = hits.groupBy(key, "start").agg(F.max_by("text", "n").alias("text"))
    return best.select(key, "start", (F.col("start") + F.length("text")).alias("end"), "text")


def write_names(names: DataFrame, path: str, *, column: str = "name") -> None:
    """Distinct names in order, a JSON line each. read_names() reads them back."""
    names.select(F.col(column).alias("name")).distinct().orderBy("name").write.json(path)

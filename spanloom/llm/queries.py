"""The queries op1 to op10 and their SQL; the pipeline's are added where it can be imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chroma, chunk_bpe, host_rules, langid, line_dedup, ngram_join, oracles, packing, pii, quality_mil, suffix_dedup


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(divisor: int, rest: int):
    """Whether a document is held out: the remainder of its id's CRC. A null id isn't."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == rest, F.lit(False))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts to ids and back, as digests."""
    return chunk_bpe.digests(table(spark, sf_dir))


def op2_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learnt from labels of those that aren't held out."""
    docs = table(spark, sf_dir)
    model = quality_mil.fit(docs, table(spark, sf_dir, "labels").filter(~fold(3, 1)))
    found = quality_mil.score(docs, model)
    return found.select("doc_id", fold(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in windows of 13 that a lesser document has too gone, a digest in place of what is left."""
    kept = suffix_dedup.remove_repeats(table(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def language_model(spark: SparkSession, sf_dir: str) -> langid.BiGru | None:
    """A network trained on a sample of the documents that aren't held out."""
    return langid.fit(table(spark, sf_dir).filter(~fold(4, 2)))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents."""
    found = langid.predict(table(spark, sf_dir), language_model(spark, sf_dir))
    return found.select("doc_id", fold(4, 2).alias("held_out"), "lang_pred", "score")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more gone, a digest in place of what is left."""
    kept = line_dedup.drop_common_lines(table(spark, sf_dir), counts=("n_lines", "n_dropped"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document, at five words and a similarity of 0.8."""
    return ngram_join.near_duplicates(table(spark, sf_dir))


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts by document and by source."""
    return host_rules.judge(table(spark, sf_dir))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, places and scores of personal data."""
    found = pii.find(table(spark, sf_dir).select("doc_id", "text"))
    base = [k.name for k in pii.KINDS if k.base]
    of = lambda kind: lambda s: s["kind"] == kind
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *[F.size(F.filter("pii", of(k))).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(line(F.filter("pii", lambda s: s["ord"] < len(base))), 256).alias("base_sha256"),
        line(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: F.format_string("%.2f", s["score"])), ",").alias("scores"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 4096 ids; a digest in place of a piece's ids."""
    return packing.pack(table(spark, sf_dir)).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op10_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings made of all embeddings (the tables have no audio): those with an id divisible by 50 sought among all, and an altered excerpt of each of these too."""
    vectors, asks = table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0
    prints = chroma.fingerprints(vectors, id_col="vec_id", audio_col="embedding", decode=chroma.render)
    altered = chroma.fingerprints(vectors.filter(asks), id_col="vec_id", audio_col="embedding", decode=chroma.excerpt, phases=4)
    return chroma.search(prints, asks, id_col="vec_id", excerpts=altered)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_quality_mil": op2_quality_mil,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_langid": op4_langid,
        "op5_line_dedup": op5_line_dedup,
        "op6_ngram_join": op6_ngram_join,
        "op7_host_rules": op7_host_rules,
        "op8_pii": op8_pii,
        "op9_packing": op9_packing,
        "op10_chroma": op10_chroma,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_suffix_dedup": oracles.OP3,
        "op5_line_dedup": oracles.OP5,
        "op6_ngram_join": oracles.OP6,
        "op7_host_rules": oracles.OP7,
        "op8_pii": oracles.OP8,
    }

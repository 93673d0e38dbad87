"""A corpus pipeline: language, common lines, near duplicates, personal data, packed sequences.

Each stage takes the documents that the one before it kept (written as Parquet and read again) and
works on all of them. All stages but the last return the columns of documents; where a stage
changes texts, n_chars follows them. Further columns of any name are carried along. An empty table
gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanloom.llm import langid, line_dedup, ngram_join, packing, pii
from spanloom.llm.queries import fold
from spanloom.llm.shared import written


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language, by a network learnt from all labelled ones not held out.

    Texts go that are null, empty, without a letter, or scored well below all labelled held-out documents
    and pieces of their size; a score at the very floor stays. Each row is judged by its text alone, so repeated rows
    share their fate. Without any labelled document all go, as there is no language to be in.
    """
    model = langid.fit_all(docs.filter(~fold(4, 2)))
    return langid.keep_languages(docs, model, floors=langid.floors(docs.filter(fold(4, 2)), model))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten documents or more have; a text may end up empty, and a null one does.

    Repeated rows (same id and text) are one document in that count, and lose the same lines; a line
    of exactly ten documents goes. A null id is an id.
    """
    return _counted(line_dedup.drop_common_lines(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates (five words, 0.8): that with the least doc_id.

    A null id counts as greater than all; of one id's texts that with the least hash stays, and of
    repeated rows any one. A similarity of exactly 0.8 is a link. Texts without a word are in no
    class, so all of these stay.
    """
    return ngram_join.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind in brackets in place of each piece of personal data.

    Where pieces overlap one bracket stands for all, with the kind of that which starts first, or of
    equal starts that listed first. Null and empty texts stay; repeated rows are treated alike.
    """
    return _counted(pii.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 4096 ids: their ids (unsigned 32-bit little-endian) with a digest.

    Each row is a document of its own, repeated ones too; a null or empty text is its end id alone.
    """
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("personal_data", personal_data), ("pack", pack)]

#: A network's predictions and a tokenizer's ids are no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

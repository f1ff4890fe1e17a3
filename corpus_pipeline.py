"""From raw documents to packed sequences: quality, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the
next one. All but the last return the columns of ``docs``; the last returns the packed pieces with their texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm.minhash import drop_near_duplicates
from tabweave.llm.packing import packed_texts
from tabweave.llm.quality import drop_low_quality
from tabweave.llm.repeats import drop_repeats
from tabweave.session import store


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the table ``labels``, calls good.

    Null, empty and blank texts go. Null and repeated ids and repeated rows are judged each by itself, long texts whole.
    Without labels of both kinds all documents stay. All columns stay, whatever their names; no rows give no rows.
    """
    return drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near or exact copies, the one with the least id.

    Null ids and null or empty texts stay as they are. Of rows that repeat an id and its text one stays; different texts
    under one id are compared like any others, and of equal ids the text with the least hash stays. Long texts are
    compared whole. All columns stay, whatever their names; no rows give no rows.
    """
    return drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand earlier; those of which nothing is left go, and ``n_chars`` follows the text.

    Null ids and null or empty texts stay as they are. Rows that repeat an id and its text are cut alike; different texts
    under one id are different documents. Long texts are searched whole. All columns stay, whatever their names; no rows
    give no rows.
    """
    removed = "removed"
    while any(c.lower() == removed for c in docs.columns):
        removed += "_"
    out = drop_repeats(docs, removed=removed).where((F.col(removed) == 0) | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.drop(removed)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(bin_id, position, doc_id, piece, start_word, n_words, text): the sequences' pieces in their order.

    Null, empty and blank texts have no words, hence no rows. Null and repeated ids are packed row by row, each with its
    own text; long texts in full sequences and a rest. Other columns aren't read; no rows give no rows.
    """
    return packed_texts(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("best-fit packing", best_fit_packing),
]

#: A conditional random field, MinHash components and a genetic algorithm: SQL can't express run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over the whole table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir))
    return docs

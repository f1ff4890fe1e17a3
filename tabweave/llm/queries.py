"""The queries of this subpackage, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    from tabweave.llm.tokencount import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and main text of every page."""
    from tabweave.llm.html import extract_pages

    return extract_pages(_table(spark, sf_dir, "pages"))


def op3_near_duplicate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector that has a near-duplicate with a smaller id, with the least of its group."""
    from tabweave.llm.multiindex import near_duplicate_vectors

    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest others, among all vectors, of each whose id is divisible by 50: the query set of a search."""
    from tabweave.llm.ann import nearest_neighbours

    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), queries=F.col("id") % 50 == 0)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of which document each sequence of 2,048 words holds."""
    from tabweave.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, and whether it is good."""
    from tabweave.llm.quality import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard and its place there."""
    from tabweave.llm.sharding import shuffle_into_shards

    return shuffle_into_shards(_table(spark, sf_dir, "documents"))


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that stand earlier already."""
    from tabweave.llm.repeats import drop_repeats

    return drop_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "text", "words_removed")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text that they decode to."""
    from tabweave.llm.bpe import decode, encode

    return decode(encode(_table(spark, sf_dir, "documents")), keep=("n_tokens", "ids"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that an earlier near or exact copy stands for, with that one."""
    from tabweave.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:2] == "op" and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}

"""Result sets as they arrive: a file stream whose checkpoint remembers what was seen."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabweave.sources.tables import SUFFIX, ResultSets, parse


def stream_texts(spark: SparkSession, directory: str) -> DataFrame:
    """New table files of a folder, as :func:`tabweave.sources.tables.read_texts` has them."""
    text = spark.readStream.schema("value string").option("pathGlobFilter", "*" + SUFFIX).text(directory, wholetext=True)
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    df = text.select(F.lit(0).alias("source_dir_ord"), F.lit(str(Path(directory).resolve())).alias("dir"), path.alias("path"), F.col("value").alias("text"))
    return df.withColumn("file", F.regexp_extract("path", "([^/]+)$", 1)).withColumn("stem", F.regexp_replace("file", r"\.tables\.json$", "")).select("source_dir_ord", "dir", "file", "stem", "path", "text")


def ingest(spark: SparkSession, directory: str, checkpoint: str, handle: Callable[[ResultSets, int], None]) -> StreamingQuery:
    """Hands each batch of new files to ``handle``, once each as far as it writes by batch number; ends when there are no more."""
    return stream_texts(spark, directory).writeStream.foreachBatch(lambda df, n: handle(parse(df, strict=False), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

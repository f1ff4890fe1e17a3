"""What operators need of a session: its shared folder, and this package on its Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20)
PACKAGE = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Makes this package importable on the workers of a local session, wherever it was started.

    On a cluster the package travels with the application (``--py-files`` or an image), as usual. Arrow batches are
    bounded by bytes too, unless the session says how: ten thousand long texts would be gigabytes.
    """
    sc = spark.sparkContext
    if spark.conf.get(BATCH).rstrip("b") == str(64 << 20):  # Spark's own default
        spark.conf.set(BATCH, BATCH_BYTES)
    if sc.master.startswith("local[") or sc.master == "local":
        if not any(str(p).endswith("/tabweave") for p in sc.listFiles):
            sc.addFile(PACKAGE, recursive=True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: the session's ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a folder of its own.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tabweave.shared.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tabweave-shared-")
        spark.conf.set("tabweave.shared.dir", found)
    return found.rstrip("/")


def spread(df: DataFrame, *keys: str, size: int = 4 << 20) -> DataFrame:
    """``df`` dealt out by ``keys`` in pieces of about ``size`` bytes of the files it is read from, so that a task's memory doesn't grow with the input.

    The session's own number of partitions is the least.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    held = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // size)), *keys)


def hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


class Stored:
    """A table written once in the shared folder; it cuts lineage, survives lost executors, and can be dropped."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/tabweave-{uuid.uuid4().hex}"
        schema = df.schema
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(schema).parquet(self.path)

    def drop(self) -> None:
        p, fs = hadoop_path(self.spark, self.path)
        fs.delete(p, True)


def store(df: DataFrame) -> DataFrame:
    """``df`` as written to and read from the shared folder."""
    return Stored(df).df

"""Tables that cut lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset, a temporary one, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='newsloom')}"
        found = _own[context.applicationId]
    return found.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Stored:
    """A DataFrame written to the shared folder and read again: all executors see it, none holds it alone."""

    def __init__(self, df: DataFrame, partition_by: list[str] | None = None):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/newsloom-{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(self.path)
        path, fs = hadoop_path(self.spark, self.path)
        fs.deleteOnExit(path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def add(self, df: DataFrame) -> None:
        df.write.option("compression", "zstd").mode("append").parquet(self.path)
        self.df = self.spark.read.schema(self.df.schema).parquet(self.path)

    def drop(self) -> None:
        path, fs = hadoop_path(self.spark, self.path)
        fs.delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    return Stored(df).df

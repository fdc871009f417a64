"""Tables between the steps of iterative jobs, in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its counted rows take at most so many bytes.
BROADCAST_BYTES = 16 << 20


_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder given to setCheckpointDir, or a new one where neither is set, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            spark.sparkContext.setCheckpointDir("file://" + os.path.realpath(tempfile.mkdtemp(prefix="loam-checkpoint-")))
        at = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return at


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def sized(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows take at most `limit` bytes, else as it is."""
    most = limit // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


class Scratch:
    """Written tables cut the lineage and survive lost executors; drop what nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def path(self, name: str) -> str:
        self.paths.append(os.path.join(folder(self.spark), f"loam-{name}-{uuid.uuid4().hex}"))
        return self.paths[-1]

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """df, written and read again; `source` of the result is its path."""
        path = self.path(name)
        before = self.spark.conf.get(_TIDY, "false")
        self.spark.conf.set(_TIDY, "true")  # the shuffle files behind a written table go at once
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_TIDY, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.source = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            remove(self.spark, table.source)
            self.paths.remove(table.source)

    def drop_all(self) -> None:
        for path in self.paths:
            remove(self.spark, path)
        self.paths = []

"""Helpers shared by the operators: scratch tables in the shared folder, sized broadcasts, connected components."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side may be broadcast up to this many bytes, measured before the join; beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def lean(spark: SparkSession) -> SparkSession:
    """Smaller Arrow batches: rows here hold whole texts, and a Python worker keeps the memory of its largest batch.

    The setting stays in the session, as results are computed after an operator has returned.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the one given to setCheckpointDir."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = held.get()
    return at


class Scratch:
    """Tables of one operator in the shared folder: written once, read many times, dropped when nothing needs them.

    A written table cuts the lineage and survives the loss of executors; the shuffle files behind it go at once.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.at = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = os.path.join(scratch(self.spark), f"{name}-{uuid.uuid4().hex}")
        before = self.spark.conf.get(_TIDY, "false")
        self.spark.conf.set(_TIDY, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_TIDY, before)
        self.at[name] = [*self.at.get(name, []), path]
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes the tables of these names; no DataFrame that still reads them may be used afterwards."""
        for name in names:
            for path in self.at.pop(name, []):
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)

    def drop_all(self) -> None:
        self.drop(*list(self.at))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder that stays, as the result of an operator reads it."""
    return Scratch(df.sparkSession).write(df, name)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows take at most `limit` bytes, else as it is."""
    most = limit // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int | None = None) -> DataFrame:
    """(node, component) for every node of `edges`; component is the smallest node reachable.

    With a number of rounds it ends after these: nodes of one label are connected, but not the other way round.

    Alternating large-star and small-star rounds (each a grouped minimum and a join, so that no
    group is gathered), written to the shared folder each round, until no edge changes. The edges of
    the last round stay there for the result; those of earlier rounds are dropped.
    """
    held = Scratch(edges.sparkSession)
    e = held.write(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "star-0")
    mark, turn = None, 0
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = held.write(star, f"star-{turn + 1}")
        seen = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        held.drop(f"star-{turn}")
        turn += 1
        if seen == mark or turn == rounds:
            break
        mark = seen
    # at the end every node but the smallest of its component points at that one
    low = e.groupBy("u").agg(F.min("v").alias("v"))
    return low.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct().join(e.select(F.col("u").alias("node")), "node", "left_anti"))

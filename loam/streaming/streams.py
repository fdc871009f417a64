"""Event streams: windowed roll-ups, sessions, alerts, with late data bounded by watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

LATE = "10 minutes"
HISTORY = "1000 years"  #: late bound for files of the past, which come in any order


def events(spark: SparkSession, path: str, schema: StructType, files: int = 1) -> DataFrame:
    """A directory of Parquet files as a stream, a few files per trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def rollup(stream: DataFrame, *keys: str, every: str = "1 hour", slide: str | None = None, late: str = LATE) -> DataFrame:
    """Counts and means per window and key."""
    window = F.window("ts", every, slide) if slide else F.window("ts", every)
    own = stream.withWatermark("ts", late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return own.select(F.col("w.start").alias("start"), *keys, "n", "mean")


def sessions(stream: DataFrame, key: str, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    own = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return own.select(key, F.col("w.start").alias("start"), "n")


def anomalies(stream: DataFrame, baselines: DataFrame, sigmas: float = 2.0) -> DataFrame:
    """Rows far from their baseline: a join of the stream with a table of one row per metric and operation."""
    joined = stream.join(F.broadcast(baselines.select("metric_type", "operation", "mean", "std")), ["metric_type", "operation"])
    return joined.where(F.abs(F.col("value") - F.col("mean")) > sigmas * F.col("std"))


def alerts(stream: DataFrame, broken: Column, *keys: str, late: str = LATE) -> DataFrame:
    """One alert per key within the watermark."""
    return stream.where(broken).withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All that is there, through the stream, into a Parquet table in a shared folder, with the number of each row's batch.

    A batch that is sent again replaces what it wrote before, and a run that is started again in the same folder goes on
    and returns the rows of earlier runs, too. complete: only the last batch counts.
    """
    spark, out = stream.sparkSession, f"{folder}/out"
    save = lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}")
    stream.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("batch", LongType())])
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(out)
    return rows if mode != "complete" else rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch")  # one row

"""Keyed state and change feeds over streams: running figures with the last values, tables that apply changes exactly once."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.scratch import remove
from ..sources.tables import latest

RUNNING = "key string, part int, n long, mean double, last array<struct<ts:timestamp,id:long,value:double>>"


HELD = "n long, mean double, ts array<timestamp>, id array<long>, value array<double>"


def running_stats(stream: DataFrame, key: str, most: int = 5, parts: int = 16, keep_ms: int | None = None) -> DataFrame:
    """Updates of (key, part, n, mean, last) of a stream of (key, ts, id, value); `combined_stats` makes one row a key of them.

    A key's rows are dealt to `parts` states, so that a hot key is not one task's. Null values are not counted, but stand in
    the last ones; null keys are a key of their own; rows without ts or id take no part. keep_ms: a state that gets no
    rows for so long forgets its last values, but not its figures; None: never.
    """

    def update(group: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, *lists = state.get if state.exists else (0, 0.0, [], [], [])
        last = [] if state.hasTimedOut else list(zip(*lists, strict=True))
        for part in rows:
            values = part["value"].dropna().to_numpy(float)
            if len(values):
                n += len(values)
                mean += float((values - mean).sum() / n)
            newest = part.sort_values(["ts", "id"]).tail(most)
            last += [(t.to_pydatetime(), int(i), None if pd.isna(v) else float(v)) for t, i, v in newest[["ts", "id", "value"]].itertuples(index=False)]
            last = sorted(last, key=lambda x: x[:2])[-most:]
        state.update((n, mean, *([x[j] for x in last] for j in range(3))))
        if keep_ms and last:
            state.setTimeoutDuration(keep_ms)
        yield pd.DataFrame({"key": [group[0]], "part": [group[1]], "n": [n], "mean": [mean], "last": [[dict(zip(("ts", "id", "value"), x, strict=True)) for x in last]]})

    own = stream.where("ts is not null and id is not null").select(F.col(key).cast("string").alias("key"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "ts", F.col("id").cast("long").alias("id"), F.col("value").cast("double").alias("value"))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if keep_ms else GroupStateTimeout.NoTimeout
    return own.groupBy("key", "part").applyInPandasWithState(update, RUNNING, HELD, "update", timeout)


def combined_stats(updates: DataFrame, most: int = 5) -> DataFrame:
    """(key, n, mean, last): the newest update of each part, put together; last: the `most` newest values in order of time."""
    newest = updates.groupBy("key", "part").agg(F.max_by(F.struct("n", "mean", "last"), "batch").alias("x"))
    out = newest.groupBy("key").agg(F.sum("x.n").alias("n"), F.try_divide(F.sum(F.col("x.n") * F.col("x.mean")), F.sum("x.n")).alias("mean"), F.sort_array(F.flatten(F.collect_list("x.last"))).alias("all"))
    return out.select("key", "n", "mean", F.slice("all", F.greatest(F.size("all") - most + 1, F.lit(1)), most).alias("last"))


class ChangeTable:
    """A table as its batches of changes in a shared folder: a base, then for each batch what it says last of each key.

    A batch counts once its marker stands. A restarted stream sends a batch again under its number: one that counts already
    is left out, one that broke off is written anew. So every batch is applied exactly once, and each number is a version.
    Rows have `key`, `event_at`, `event` ('created', 'updated' or 'deleted') and the fields; of a key the latest event_at counts, of
    equal ones the later batch; null dates come first. Changes without key are left out.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str = "id"):
        self.spark, self.folder, self.key = spark, folder, key
        self.schema = f"{schema}, event string, event_at timestamp"

    def _path(self, batch: int) -> str:
        return os.path.join(self.folder, "changes", f"batch={batch:09d}")

    def versions(self) -> list[int]:
        """Numbers of the batches that count."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.folder, "changes"))
        files = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not files.exists(path):
            return []
        marks = [s.getPath() for s in files.listStatus(path)]
        return sorted(int(p.getName().removeprefix("batch=")) for p in marks if p.getName().startswith("batch=") and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def apply(self, batch: DataFrame, number: int) -> None:
        """Writes one batch; for foreachBatch."""
        if number in self.versions():
            return
        names = [f.split()[0] for f in self.schema.split(", ")]
        own = batch.where(F.col(self.key).isNotNull()).select(*names)
        newest = own.groupBy(self.key).agg(F.max_by(F.struct(*[c for c in names if c != self.key]), F.struct("event_at", F.xxhash64(*names))).alias("x")).select(self.key, "x.*")
        newest.select(*names).write.mode("overwrite").parquet(self._path(number))

    def run(self, changes: DataFrame) -> None:
        """All changes that are there, as a stream that goes on where it ended."""
        writer = changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", os.path.join(self.folder, "checkpoint"))
        writer.trigger(availableNow=True).start().awaitTermination()

    def table(self, base: DataFrame, version: int | None = None) -> DataFrame:
        """The rows of `base` after all changes up to a version (all that count); columns of base."""
        counted = [v for v in self.versions() if version is None or v <= version]
        if not counted:
            return base
        parts = self.spark.read.schema(self.schema).parquet(*[self._path(v) for v in counted]).withColumn("__file", F.input_file_name())
        number = F.regexp_extract("__file", r"batch=(\d+)", 1).cast("long").alias("batch")
        last = latest(parts.withColumn("batch", number), self.key, F.desc_nulls_last("event_at"), F.desc("batch"))
        kept = base.join(last.select(self.key), self.key, "left_anti")
        return kept.select(*base.columns).unionByName(last.where("event <> 'deleted'").select(*base.columns))

    def compact(self, base: DataFrame, into: str) -> DataFrame:
        """The present table, written as a new base; batches written so far go, so no event may come late after this."""
        done = self.versions()
        self.table(base).write.mode("overwrite").parquet(into)
        out = self.spark.read.schema(base.schema).parquet(into)
        for v in done:
            remove(self.spark, self._path(v))
        return out

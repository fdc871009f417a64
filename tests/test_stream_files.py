"""Results of streams do not depend on how the events are dealt over files."""

import datetime
import os
import uuid

from pyspark.sql import functions as F

from loam.streaming import streams


def test_files_out_of_order_count_in_full(spark, tmp_path):
    day = lambda h: datetime.datetime(2024, 1, 1 + h // 24, h % 24)
    hours = [90, 5, 40, 6, 91, 0]
    for i, h in enumerate(hours):
        rows = [(day(h), "a", 300.0), (day(h) + datetime.timedelta(minutes=5), "a", 300.0), (day(h), "b", 1.0)]
        spark.createDataFrame(rows, "ts timestamp, k string, value double").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        for f in os.scandir(f"{tmp_path}/in/{i}"):
            if f.name.startswith("part"):
                os.utime(f.path, (1e9 + 100 * i,) * 2)
    events = lambda: streams.events(spark, f"{tmp_path}/in/*", spark.read.parquet(f"{tmp_path}/in/0").schema, 1)
    run = lambda df, mode: streams.run_once(df, f"{tmp_path}/{uuid.uuid4().hex}", mode)
    hour = events().withColumn("hour", F.date_trunc("hour", "ts"))
    alerts = run(streams.alerts(hour, F.col("value") > 200, "k", "hour", late=streams.HISTORY).select("k", "hour"), "append")
    assert sorted(r.hour for r in alerts.collect()) == sorted(map(day, hours))
    sessions = run(streams.sessions(events(), "k", late=streams.HISTORY), "complete")
    assert sorted((r.k, r.start, r.n) for r in sessions.collect()) == sorted((k, day(h), n) for h in hours for k, n in (("a", 2), ("b", 1)))
    means = run(streams.rollup(events(), "k", late=streams.HISTORY), "complete")
    assert sorted((r.k, r.start, r.n) for r in means.collect()) == sorted((k, day(h), n) for h in hours for k, n in (("a", 2), ("b", 1)))
    assert not [t for t in spark.catalog.listTables() if t.isTemporary]

"""Streams that keep state or apply changes: the same as one batch, also when a run breaks off and starts again."""

from __future__ import annotations

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from loam.operators import ingestion
from loam.streaming import state, streams


def files(spark, folder, parts, schema):
    """One file after the other, in this order."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i}")
        for f in os.scandir(f"{folder}/{i}"):
            os.utime(f.path, (1e9 + 100 * i,) * 2)
    return lambda: streams.events(spark, f"{folder}/*", spark.read.parquet(f"{folder}/0").schema, 1)


def test_running_stats_over_batches(spark, tmp_path):
    draw, day = random.Random(1), datetime.datetime(2024, 1, 1)
    rows = [(draw.choice(["hot"] * 8 + ["b", None]), day + datetime.timedelta(seconds=draw.randrange(500)), i, draw.choice([None, 1.0, 2.5, -3.0])) for i in range(300)]
    awkward = [("b", None, 900, 1.0), ("b", day, None, 1.0)]
    parts = [rows[:40], rows[40:41], rows[41:250] + awkward, rows[250:]]
    read = files(spark, f"{tmp_path}/in", parts, "k string, ts timestamp, id long, value double")
    out = state.combined_stats(streams.run_once(state.running_stats(read(), "k", most=4, parts=3), f"{tmp_path}/run", "update"), 4)
    got = {r.key: (r.n, round(r["mean"], 9) if r["mean"] is not None else None, [x.id for x in r["last"]]) for r in out.collect()}
    want = {}
    for k in ("hot", "b", None):
        own = sorted((r[1], r[2], r[3]) for r in rows if r[0] == k)
        values = [v for _, _, v in own if v is not None]
        want[k] = (len(values), round(sum(values) / len(values), 9), [i for _, i, _ in own[-4:]])
    assert got == want


FEED = "id long, status string, event string, event_at timestamp"


def feed():
    draw, day = random.Random(6), datetime.datetime(2024, 1, 1)
    rows = [(draw.randrange(40), f"s{i}", draw.choice(["created", "updated", "updated", "deleted"]), day + datetime.timedelta(minutes=draw.randrange(90))) for i in range(160)]
    return [rows[:50], rows[50:60], rows[60:120], rows[120:] + [(None, "x", "created", day), (39, "old", "updated", None)]]


def test_changes_apply_exactly_once(spark, tmp_path):
    parts = feed()
    read = files(spark, f"{tmp_path}/in", parts, FEED)
    base = spark.createDataFrame([(i, "base") for i in range(0, 60, 2)], "id long, status string")
    rows = lambda t: sorted(map(tuple, t.collect()))
    whole = state.ChangeTable(spark, f"{tmp_path}/whole", "id long, status string")
    assert rows(whole.table(base)) == rows(base)
    whole.run(read())
    assert whole.versions() == [0, 1, 2, 3]

    class Breaks(state.ChangeTable):
        """Stops once before it writes batch 1, and once after it wrote batch 2 but before the stream knows."""

        stops = {1: "before", 2: "after"}

        def apply(self, batch, number):
            stop = self.stops.pop(number, None)
            if stop == "before":
                raise RuntimeError("killed")
            super().apply(batch, number)
            if stop == "after":
                raise RuntimeError("killed")

    broken = Breaks(spark, f"{tmp_path}/broken", "id long, status string")
    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            broken.run(read())
    assert broken.versions() == [0, 1, 2]
    again = state.ChangeTable(spark, f"{tmp_path}/broken", "id long, status string")  # a new driver
    again.run(read())
    for version in (0, 1, 2, 3, None):
        assert rows(again.table(base, version)) == rows(whole.table(base, version))
    for version in range(4):  # versions against plain Python
        last: dict = {}
        for number, part in enumerate(parts[: version + 1]):
            for i, s, e, t in part:
                if i is not None:
                    key = (t is not None, t or datetime.datetime.min, number)
                    if i not in last or key > last[i][0]:
                        last[i] = (key, [])
                    if key == last[i][0]:
                        last[i][1].append((s, e))
        want = {i: ["base"] for i in range(0, 60, 2) if i not in last} | {i: [s for s, e in v if e != "deleted"] for i, (_, v) in last.items()}
        got = dict(rows(whole.table(base, version)))
        assert all(got[i] in want[i] for i in got) and all(i in got for i, v in want.items() if v and not any(e == "deleted" for _, e in last.get(i, (0, []))[1]))
    packed = whole.compact(base, f"{tmp_path}/base2")
    assert rows(packed) == rows(again.table(base)) and whole.versions() == []


def test_stream_goes_on_in_its_folder(spark, tmp_path):
    read = files(spark, f"{tmp_path}/in", [[(1,)], [(2,)]], "id long")
    first = streams.run_once(read(), f"{tmp_path}/run")
    assert sorted(r.id for r in first.collect()) == [1, 2]
    spark.createDataFrame([(3,)], "id long").coalesce(1).write.parquet(f"{tmp_path}/in/9")
    assert sorted(r.id for r in streams.run_once(read(), f"{tmp_path}/run").collect()) == [1, 2, 3]


def test_ingestion_stream_equals_batch(spark, tmp_path):
    text = "Ada Byron met Charles Babbage. It means 12 steps. " * 40
    docs = [(i, t, k, f"f{i}") for i, (t, k) in enumerate([(text, "txt"), ("short", None), (None, "md"), ("", "csv"), ("a,b\n1,2\n3,4", "csv"), (text.replace(". ", ".\n\n"), "txt"), ('["x y", "z"]', "json"), ("\f".join([text] * 3), "pdf")])]
    schema = "id long, text string, file_type string, file_name string"
    df = spark.createDataFrame(docs, schema)
    read = files(spark, f"{tmp_path}/in", [docs[:3], docs[3:4], docs[4:]], schema)
    chunks = ingestion.enriched_chunks(df)
    live = streams.run_once(ingestion.enriched_chunks(read()), f"{tmp_path}/run").drop("batch")
    assert sorted(map(str, live.collect())) == sorted(map(str, chunks.collect()))
    mentions, edges = ingestion.entities_of(df)
    got = {r.memory_id: r for r in ingestion.stored_documents(df, chunks, mentions, edges).collect()}
    assert len(got) == len(docs) and {i for i, r in got.items() if not r.success} == {2, 3}
    for i, r in got.items():
        own = chunks.where(F.col("memory_id") == i)
        assert (r.chunks, r.vectors) == (own.count(),) * 2 and r.entities == mentions.where(F.col("memory_id") == i).count()
    assert got[0].entities == 3 and got[0].relationships == 2  # Ada Byron, Charles Babbage, It
    one = chunks.where("memory_id = 4").first()
    assert (one.chunk_id, one.context) == ("4_chunk_0", "file: f4 | type: row | chunk: 1 | content: numeric")

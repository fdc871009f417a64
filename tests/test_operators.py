"""Operators on small literal inputs."""

import datetime

import pytest
from pyspark.sql import functions as F

from loam.functions import register
from loam.functions import vectors as V
from loam.operators import chunking, enrichment, experiments, graph, metrics, retrieval
from loam.sources import tables


def one(df):
    return df.first()


@pytest.mark.parametrize("n", [0, 1, 393, 394, 395, 800])
@pytest.mark.parametrize("overlap", [0, 50])
def test_token_chunks(spark, n, overlap):
    words = [f"w{i}" for i in range(n)]
    got = [r.chunk.split() for r in chunking.token_chunks(spark.createDataFrame([(" ".join(words),)], "text string"), 512, overlap).orderBy("chunk_no").collect()]
    want = [words[i : i + 394] for i in range(0, max(n - overlap, 1), 394 - overlap)] if n else []
    assert got == want


def test_packing_never_splits_a_unit(spark):
    sizes = [3, 4, 5, 100, 1, 1, 10, 9]
    got = one(spark.range(1).select(chunking.packed(F.array(*map(F.lit, sizes)), F.lit(10)).alias("c"))).c
    assert [(g.first, g.last) for g in got] == [(0, 1), (2, 2), (3, 3), (4, 5), (6, 6), (7, 7)]
    assert one(spark.range(1).select(chunking.packed(F.array().cast("array<int>"), F.lit(10)).alias("c"))).c == []


def test_sections(spark):
    df = spark.createDataFrame([(1, "intro\n# One\na\nb\n## Two\nc")], "id long, text string")
    assert [(r.section, r.title, r.n_lines) for r in chunking.sections(df, "id").orderBy("section").collect()] == [(0, "", 1), (1, "One", 2), (2, "Two", 1)]


def test_tags_and_estimates(spark):
    texts = ["For example, 3?", "Maybe. " + "x" * 60, "It might, perhaps; obviously", "So according to the API", "It means a process, therefore a result"]
    df = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], "i int, t string, about string")
    got = df.orderBy("i").select(enrichment.tags("t").alias("tags"), F.round(enrichment.confidence("t", "about"), 6).alias("c"), F.round(enrichment.risk("t"), 6).alias("r")).collect()
    assert got[0].tags == ["examples", "questions", "numeric"] and got[0].c == 0.6
    assert got[1].c == 0.55 and got[2].r == 0.5 and got[3].r == 0.0 and got[3].tags == ["technical"]
    assert got[4].tags == ["definitions", "procedural", "conclusions"]


def test_upsert_and_feed(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 5)], "id int, text string, updated_at int")
    delta = spark.createDataFrame([(2, "B", 1), (3, "old", 2), (4, "d", 1)], "id int, text string, updated_at int")
    assert sorted((r.id, r.text) for r in tables.upserted(base, delta).collect()) == [(1, "a"), (2, "B"), (3, "c"), (4, "d")]
    feed = spark.createDataFrame([(1, "x", "updated", 1), (1, "x", "deleted", 2), (9, "n", "created", 1)], "id int, text string, event string, event_at int")
    assert sorted((r.id, r.text) for r in tables.changed(base.drop("updated_at"), feed).collect()) == [(2, "b"), (3, "c"), (9, "n")]


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "f"), ("f", "g")], "src string, dst string")
    seeds = spark.createDataFrame([("d",)], "name string")
    assert sorted((r.name, r.depth) for r in graph.reached(edges, seeds, 2).collect()) == [("e", 1), ("f", 2)]
    assert {r.name: r.component for r in graph.components(edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "d", "g": "d"}
    assert abs(sum(r["rank"] for r in graph.pagerank(edges, 5).collect()) - 1) < 1e-9
    assert len({r.label for r in graph.communities(edges, 3).where("name in ('a', 'b', 'c')").collect()}) <= 3


def test_baselines_and_trends(spark):
    at = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, at + datetime.timedelta(minutes=i), "op", "m", float(i)) for i in range(100)], "event_id int, ts timestamp, operation string, metric_type string, value double")
    assert metrics.baselines(df.where("event_id < 99")).count() == 0 and one(metrics.baselines(df)).p50 == 49.5
    r = one(metrics.trends(df))
    assert (r.slope, r.r2, r.direction) == (1.0, 1.0, "increasing")
    flat = df.withColumn("value", F.lit(5.0))
    scored = metrics.against(flat, metrics.baselines(flat)).withColumn("s", metrics.severity())
    assert scored.where("s = 'info'").count() == 100


def test_fusion_and_min_max(spark):
    left = spark.createDataFrame([(1, 1, 0.5, 1), (1, 2, 0.5, 2)], "qid int, id int, score double, rank int")
    right = spark.createDataFrame([(1, 3, 1.0, 1)], "qid int, id int, score double, rank int")
    assert {r.id: r.score for r in retrieval.fused(left, right, 0.5, 5).collect()} == {1: 0.25, 2: 0.25, 3: 0.5}
    assert {r.id: r.score for r in retrieval.reciprocal(left, right).collect()} == {1: round(1 / 61 + 1 / 62, 6), 2: round(1 / 62 + 1 / 62, 6), 3: round(1 / 63 + 1 / 61, 6)}
    assert {r.scaled for r in retrieval.min_max(left, "score", "qid").collect()} == {0.5}


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0], [2.0, 0.0, 0.0]), ([0.0, 0.0, 0.0], [1.0, 1.0, 1.0])], "a array<double>, b array<double>")
    got = df.select(V.cosine("a", "b").alias("c"), V.l2("a", "b").alias("d"), V.norm("a").alias("n")).collect()
    assert got[0].c == pytest.approx(1 / 3) and got[0].d == 3.0 and got[0].n == 3.0 and got[1].c is None


def test_variant_shares(spark):
    got = spark.range(5000).select(experiments.variant("e", "id", {"a": 0.5, "b": 0.3, "c": 0.2}).alias("v")).groupBy("v").count().collect()
    assert {r.v: round(r["count"] / 5000, 1) for r in got} == {"a": 0.5, "b": 0.3, "c": 0.2}


def test_registered_functions(spark):
    assert "estimate_tokens" in register.register_functions(spark)
    r = one(spark.sql("SELECT estimate_tokens('a b c') t, confidence_level(81D) l, text_jaccard('a b', 'b c') j, l2_distance(array(0D, 3D), array(4D, 0D)) d, cosine_distance(array(1D, 0D), array(0D, 1D)) c"))
    assert (round(r.t, 6), r.l, round(r.j, 6), r.d, r.c) == (3.9, "high", 0.333333, 5.0, 1.0)
    embed = register.embedder(lambda: lambda texts: [[float(len(t))] for t in texts], prefix="q: ")
    assert one(spark.createDataFrame([("abc",)], "t string").select(embed("t").alias("v"))).v == [6.0]


def test_significance(spark):
    df = spark.createDataFrame([("m", "v", 1.96)], "metric string, variant string, t double")
    assert one(experiments.significance(df)).p == pytest.approx(0.05, abs=1e-3)

"""The main search against plain Python, and the rules around it."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F

from loam.operators import memory_search as S
from loam.operators import retrieval as R


def test_search_memory(spark):
    draw, vec = random.Random(3), np.random.default_rng(3)
    words = ["alpha", "beta", "gamma", "the", "delta"]
    head = "x" * 200
    docs = [(i, draw.choice(["", head]) + " ".join(draw.choices(words, k=8)), vec.normal(size=6).tolist()) for i in range(40)] + [(40, None, vec.normal(size=6).tolist()), (41, "alpha beta", None)]
    queries = [(0, "alpha Ada Byron", vec.normal(size=6).tolist()), (1, "gamma delta Nobody", vec.normal(size=6).tolist()), (2, 'about "the thing"', vec.normal(size=6).tolist()), (3, None, vec.normal(size=6).tolist())]
    entities = [("Ada Byron", "PERSON", 0.95), ("Ada Byron", "PLACE", None), ("the thing", "PERSON", 0.1), ("Charles", "PERSON", 0.7), ("Far", "PERSON", 0.7)]
    edges = [("Ada Byron", "Charles"), ("Charles", "Far"), ("Far", "Farther"), ("the thing", "the thing")]
    frames = spark.createDataFrame(docs, "id long, text string, v array<double>"), spark.createDataFrame(queries, "qid long, text string, v array<double>"), spark.createDataFrame(entities, "name string, type string, confidence double"), spark.createDataFrame(edges, "src string, dst string")
    hits = sorted((r.qid, r.name, r.type, r.score, r.connected, r.relationships) for r in S.graph_hits(frames[1], *frames[2:]).collect())
    assert hits == [(0, "Ada Byron", "PERSON", 0.95, 2, 1), (0, "Ada Byron", "PLACE", 0.8, 2, 1), (2, "the thing", "PERSON", 0.1, 0, 1)]
    k, least = 5, 0.15
    got: dict = {}
    for r in S.search_memory(*frames, k, least).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.key, r.source, r.score, round(r.confidence, 8)))
    near: dict = {}
    for r in R.hybrid_scan(*frames[:2], 2 * k).collect():
        near.setdefault(r.qid, []).append((f"memory:{r.id:019d}", dict((i, t) for i, t, _ in docs)[r.id], r.score, "vector"))
    terms = lambda t: {w for w in re.findall("[a-z0-9]+", (t or "").lower()) if w not in R.STOP}
    for q, text, _ in queries:
        found = near.get(q, []) + [(f"entity:{n}", f"Entity: {n} ({t})", s, "graph") for i, n, t, s, _, _ in hits if i == q]
        best: dict = {}
        for key, content, score, source in found:
            h = (content or "")[:200] if content is not None else None
            if h not in best or (-score, key) < (-best[h][2], best[h][0]):
                best[h] = (key, content, score, source)
        ranked = sorted(((-round(len(terms(text) & terms(c)) / len(terms(text)), 6) if terms(text) else -0.0, -s, key, o) for key, c, s, o in best.values() if s >= least))[:k]
        assert got.get(q, []) == [(key, o, -share, round(-s, 8)) for share, s, key, o in ranked]


def test_graph_relevance_and_entities(spark):
    rows = [("red Dog", {"name": "Dog", "more": "RED dog x"}, 3), ("red", {"name": None}, 100), (None, {"name": "a"}, None), ("a b c d e f g h i j k l", {"n": "a b c d e f g h i j k l"}, 0), ("x", None, 1)]
    df = spark.createDataFrame(rows, "q string, p map<string,string>, n int")
    assert [round(r.s, 6) for r in df.select(S.graph_relevance("q", "p", "n").alias("s")).collect()] == [0.45, 0.3, 0.0, 1.0, 0.05]
    nodes = spark.createDataFrame([("a", "x", 1, "2024-01-01"), ("b", "x", 1, "2024-01-03"), ("c", "x", 2, "2024-01-02"), ("d", "y", 1, None), ("e", "x", 1, None)], "name string, type string, w int, t string").withColumn("created_at", F.col("t").cast("timestamp"))
    names = lambda out: [r.name for r in out.collect()]
    assert names(S.find_entities(nodes, "x", {"w": 1})) == ["b", "a", "e"] and names(S.find_entities(nodes, limit=2, offset=1)) == ["c", "a"]


def test_trading_rules(spark):
    long = "word " * 21
    rows = [("should I buy more of this now", long + "risk ⚠️ Verification", "context", 9), ("no", "short", "", 0), (None, None, None, None), ("sell", "RISK", "c", 2)]
    got = [r.c for r in spark.createDataFrame(rows, "q string, r string, c string, n int").select(S.trading_confidence("q", "r", "c", "n").alias("c")).collect()]
    assert got == [98.0, 85.0 - 10 - 5 - 3, 85.0 - 10 - 5 - 3, 85.0 + 5 + 4 - 5 - 3 + 2 + 2]
    answers = [(96.0, 80.0, "a", True, 0.2, 3, True), (94.96, 75.0, "a", True, 0.5, 1, True), (99.0, 60.0, "", False, 0.9, 0, False), (None, None, None, None, None, None, None)]
    out = S.trading_checks(spark.createDataFrame(answers, "confidence double, hallucination double, agent_id string, accurate boolean, temperature double, memories int, trading boolean")).collect()
    assert [r.approved for r in out] == [True, False, False, False] and [r.level for r in out[:3]] == ["rock_solid", "high", "rock_solid"]
    assert out[0].warnings == [] and out[1].warnings == ["Confidence 95.0% below required 95% threshold", "CRITICAL: Trading query detected but safety requirements not met"]
    assert out[2].warnings == ["Hallucination score 60.0% below threshold", "No memory context available for decision support"] and len(out[3].warnings) == 3


def test_fallback_and_least_score(spark):
    df = spark.createDataFrame([(1, [1.0], [2.0, 2.0]), (2, None, [2.0, 2.0]), (3, None, None)], "id long, a array<double>, b array<double>")
    out = S.with_fallback(df, {"first": F.col("a"), "second": F.col("b")}).orderBy("id").collect()
    assert [(r.v, r.model) for r in out] == [([1.0], "first"), ([2.0, 2.0], "second"), (None, None)]
    assert S.at_least(spark.createDataFrame([(0.5,), (0.4,), (None,)], "score double"), 0.5).count() == 1


def test_adaptive_retrieval(spark):
    vec = np.random.default_rng(4)
    docs = [(i, t, vec.normal(size=6).tolist()) for i, t in enumerate(["red dog runs", "red dog runs", "blue cat", None, "a long text about dogs and cats", ""])]
    queries = [(0, "red dog", vec.normal(size=6).tolist()), (1, "who is Ada Byron", vec.normal(size=6).tolist()), (2, "how does Ada Byron compare", vec.normal(size=6).tolist()), (3, None, vec.normal(size=6).tolist()), (4, "what about nobody", vec.normal(size=6).tolist()), (5, "one two three four five six seven eight nine ten eleven", vec.normal(size=6).tolist())]
    entities, edges = [("Ada Byron", "PERSON", 0.9)], [("Ada Byron", "Charles")]
    frames = spark.createDataFrame(docs, "id long, text string, v array<double>"), spark.createDataFrame(queries, "qid long, text string, v array<double>"), spark.createDataFrame(entities, "name string, type string, confidence double"), spark.createDataFrame(edges, "src string, dst string")
    got: dict = {}
    for r in S.adaptive_retrieve(*frames, k=4, penalty=0.5, least=-1.0).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.route, r.key, r.score))
    assert {q: x[0][0] for q, x in got.items()} == {0: "vector", 1: "graph", 2: "hybrid", 3: "vector", 5: "hybrid"}
    assert got[1] == [("graph", "entity:Ada Byron", round((0.9 + 2 / 3) / 2, 6))]  # ada and byron of who, ada, byron
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    for q in (0, 3):
        near = sorted(((-float(unit(v) @ unit(queries[q][2])), i) for i, _, v in docs))[:4]
        assert sorted(k for _, k, _ in got[q]) == sorted(f"memory:{i:019d}" for _, i in near)
        before, want = [], {}
        for s, i in near:
            w = set((docs[i][1] or "").lower().split(" "))
            worst = max((len(w & u) / len(w | u) for u in before), default=0.0)
            before.append(w)
            asked = {x for x in (queries[q][1] or "").split() if x}
            share = len(asked & set((docs[i][1] or "").split())) / len(asked) if asked else 0.0
            want[f"memory:{i:019d}"] = (round(-s * (1 - 0.5 * worst), 6) + share) / 2
        assert all(abs(want[k] - s) < 2e-6 for _, k, s in got[q]) and [s for *_, s in got[q]] == sorted((s for *_, s in got[q]), reverse=True)
    assert "entity:Ada Byron" in [k for _, k, _ in got[2]] and len({k for _, k, _ in got[2]}) == len(got[2])

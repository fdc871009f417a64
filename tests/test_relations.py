"""Traversal, paths and timelines over small graphs against plain Python, with hubs dealt to several tasks."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from loam.operators import relations as G

SCHEMA = "src string, dst string, type string, rel_id string, valid_from timestamp, valid_to timestamp, confidence double, created_at timestamp"


def edges_of(spark, rows):
    """[(src, dst, type, confidence)]"""
    full = [(s, d, t, f"{s}-{t}-{d}", None, None, c, None) for s, d, t, c in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def graph():
    draw = random.Random(4)
    rows = [(f"n{draw.randrange(40)}", f"n{draw.randrange(40)}", draw.choice(["is", "has"]), draw.choice([None, 0.2, 0.9, 1.0])) for _ in range(55)]
    rows += [("hub", f"n{i}", "has", 0.95) for i in range(0, 40, 2)] + [(f"m{i}", "hub", "is", 0.5) for i in range(30)] + [("loop", "loop", "is", 1.0), ("a", "b", "is", 1.0)]
    return list({(s, t, d): (s, d, t, c) for s, d, t, c in rows}.values())


def all_paths(rows, start, most):
    """Every walk without a repeated node: (end, edges)."""
    out, level = [(start, ())], [(start, (), (start,))]
    for _ in range(most):
        level = [(o, p + (f"{s}-{t}-{d}",), v + (o,)) for n, p, v in level for s, d, t, _c in rows for a, o in ((s, d), (d, s)) if a == n and s != d and o not in v]
        out += [(n, p) for n, p, _ in level]
    return out


def test_shortest_paths(spark, graph):
    names = sorted({x for r in graph for x in r[:2]})
    pairs = list(itertools.islice(itertools.product(names[::5], names[1::4]), 150)) + [("hub", "hub"), ("a", "hub"), ("a", None), (None, "a"), ("absent", "a"), ("a", "b"), ("a", "b")]
    found = G.shortest_paths(edges_of(spark, graph), spark.createDataFrame(pairs, "src string, dst string"), 3, hub=1 / 30)
    got = {(r.src, r.dst): (r.length, tuple(r.path)) for r in found.collect()}
    want = {}
    for s, d in set(pairs):
        reached = [(len(p), p) for n, p in all_paths(graph, s, 3) if n == d] if s and d else []
        if reached:
            want[s, d] = min(reached)
    assert got == want and {x[0] for x in got.values()} == {0, 1, 2, 3}


@pytest.mark.parametrize("directed", [True, False])
def test_traversal_with_filters(spark, graph, directed):
    kind = lambda n: "even" if n[-1] in "02468" else "hub" if n == "hub" else "odd"
    names = sorted({x for r in graph for x in r[:2]})
    nodes = spark.createDataFrame([(n, kind(n)) for n in names], "name string, type string")
    seeds = ["hub", "n1", "n2", "m3", "absent"]
    out = G.traversed(edges_of(spark, graph), nodes, spark.createDataFrame([(x,) for x in [*seeds, "n1", None]], "name string"), 3, ["has", "is"], ["even", "hub"], 0.5, directed, hub=1 / 30)
    got = {(r.seed, r.name): (r.depth, tuple(r.path), r.confidence, r.type) for r in out.collect()}
    want = {}
    for seed in seeds[:4]:
        level = {seed: ((seed,), 1.0)}
        want[seed, seed] = (0, (seed,), 1.0, kind(seed))
        for depth in range(1, 4):
            new: dict = {}
            for n, (path, sure) in level.items():
                for s, d, t, c in graph:
                    for a, b in ((s, d), (d, s)) if not directed else ((s, d),):
                        c = 1.0 if c is None else c
                        if a == n and s != d and c >= 0.5 and kind(b) in ("even", "hub") and (seed, b) not in want:
                            step = ((*path, t, b), min(sure, c))
                            new[b] = min(new.get(b, step), step)
            want |= {(seed, n): (depth, p, c, kind(n)) for n, (p, c) in new.items()}
            level = new
    assert got == want and len(got) > 20


def test_timeline_has_open_ends(spark):
    rows = [("a", "b", "t", "r1", "2000-01-01", "2001-01-01"), ("a", "b", "t", "r2", None, "2001-01-01"), ("b", "a", "t", "r3", "2000-01-01", None), ("a", "a", "t", "r4", None, None), ("a", "b", "u", "r5", "1999-01-01", "2001-01-01"), ("a", "b", "t", "r6", "2000-01-01", "2003-01-01"), ("c", "d", "t", "r7", None, None)]
    df = spark.createDataFrame(rows, "src string, dst string, type string, rel_id string, f string, u string").select("src", "dst", "type", "rel_id", F.col("f").cast("timestamp").alias("valid_from"), F.col("u").cast("timestamp").alias("valid_to"), F.lit(1.0).alias("confidence"), F.lit("1998-01-01").cast("timestamp").alias("created_at"))
    who = spark.createDataFrame([("a",), ("a",), (None,)], "name string")
    ids = lambda out: sorted(r.rel_id for r in out.collect())
    assert ids(G.timeline(df, who, "2000-01-01", "2002-01-01")) == ["r1", "r2", "r3", "r4"]
    assert ids(G.timeline(df, who, None, "2002-01-01")) == ["r1", "r2", "r3", "r4", "r5"]
    assert ids(G.timeline(df, who)) == ["r1", "r2", "r3", "r4", "r5", "r6"]
    assert {r.rel_id: str(r.at)[:10] for r in G.timeline(df, who).collect()}["r2"] == "1998-01-01"
    facts = df.withColumnRenamed("src", "entity")
    assert ids(G.facts_of(facts, who, "2000-01-01", "2002-01-01")) == ["r1"]  # here a missing bound is out
    assert ids(G.facts_of(facts, who, "2000-01-01", None, ["t"])) == ["r1", "r6"]
    assert ids(G.facts_of(facts, who, types=["u"])) == ["r5"]
    assert ids(G.touching(df, who, "in")) == ["r3", "r4"] and ids(G.touching(df, who, "out", ["u"])) == ["r5"]


def test_subgraph_and_created_between(spark, graph):
    df = edges_of(spark, graph)
    nodes, own = G.subgraph(df, spark.createDataFrame([("n1",), ("a",), ("nowhere",)], "name string"), 2, hub=1 / 30)
    want = {n for s in ("n1", "a", "nowhere") for n, _ in all_paths(graph, s, 2)}
    assert {r.name for r in nodes.collect()} == want
    assert sorted(r.rel_id for r in own.collect()) == sorted(f"{s}-{t}-{d}" for s, d, t, _ in graph if s in want and d in want)
    assert G.subgraph(df, spark.createDataFrame([], "name string"), 2)[1].count() == 0
    named = spark.createDataFrame([("a", "x", "2000-05-05"), ("b", "x", "2000-06-05"), ("hub", "y", "2000-06-05")], "name string, type string, t string").withColumn("created_at", F.col("t").cast("timestamp"))
    dated = df.withColumn("created_at", F.lit("2000-06-01").cast("timestamp"))
    kept, own = G.created_between(dated, named, "2000-05-01", "2000-07-01", ["x"], ["is"])
    assert sorted(r.name for r in kept.collect()) == ["a", "b"] and [r.rel_id for r in own.collect()] == ["a-is-b"]
    assert G.created_between(dated, named, "2000-06-02", "2000-07-01")[1].count() == 0


def test_connected_counts_by_bits_of_seeds(spark):
    rng = random.Random(5)
    pairs = sorted({(f"n{rng.randrange(150)}", f"n{rng.randrange(150)}") for _ in range(260)} | {("hub", f"n{i}") for i in range(0, 150, 3)} | {("n1", "n1"), ("out", "n2")})
    near = {}
    for a, b in pairs:
        if a != b and "out" not in (a, b):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    names = sorted({x for p in pairs for x in p} - {"out"})
    nodes = spark.createDataFrame([(n,) for n in names] + [("alone",)], "name string")
    seeds = spark.createDataFrame([(n,) for n in [*names, "alone", "unknown", "n1"]], "name string")
    for depth in (1, 2, 3):
        want = {}
        for n in names:
            reach = {n}
            for _ in range(depth):
                reach |= {y for x in reach for y in near.get(x, ())}
            if len(reach) > 1:
                want[n] = len(reach) - 1
        got = G.connected(spark.createDataFrame(pairs, "src string, dst string"), nodes, seeds, depth, hub=0.02).collect()
        assert {r["name"]: r.connected for r in got} == want and len(got) == len(want)


def test_last_step_does_not_follow_wide_nodes(spark):
    """Many pairs around one wide node: the last step meets between the levels, and paths equal those without a wide node."""
    pairs = [(f"c{i}", "nation") for i in range(40)] + [("s", "nation"), ("s", "p"), ("c1", "p2"), ("p2", "nation")]
    edges = spark.createDataFrame([(a, b, f"{a}|{b}") for a, b in pairs], "src string, dst string, rel_id string")
    asked = spark.createDataFrame([(f"c{i}", "p") for i in range(5)], "src string, dst string")
    found = {wide: sorted(tuple(r) for r in G.shortest_paths(edges, asked, 3, wide=wide).select("src", "length", "path").collect()) for wide in (3, 1024)}
    assert found[3] == found[1024] == [(f"c{i}", 3, [f"c{i}|nation", "s|nation", "s|p"]) for i in range(5)]

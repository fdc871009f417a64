"""Graph operators over hubs, against plain Python."""

import random

import pytest

from loam.operators import graph


def test_similarity_of_neighbours(spark):
    rng = random.Random(3)
    pairs = {("hub", f"n{i}") for i in range(60)} | {(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(90)}
    pairs = sorted((a, b) for a, b in pairs if a != b)
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    classes = {}
    for name, own in near.items():
        classes.setdefault(frozenset(own), []).append(name)
    first = {min(names): (own, len(names)) for own, names in classes.items()}
    for least in (0.3, 0.5, 1.0):
        want = {(a, b, m, n, round(len(x & y) / len(x | y), 6)) for a, (x, m) in first.items() for b, (y, n) in first.items() if a < b and len(x & y) >= least * len(x | y)}
        got = graph.neighbour_similarity(spark.createDataFrame(pairs, "src string, dst string"), least).collect()
        assert {(r.a, r.b, r.members_a, r.members_b, r.similarity) for r in got} == want and len(got) == len(want)


def hubs(draw, names, neighbours, of):
    """Sets of neighbours drawn at random, every third one like the one before it."""
    sets: list[set] = []
    for i in range(names):
        own = set(draw.sample(range(of), draw.randrange(*neighbours)))
        sets.append(set(draw.sample(sorted(sets[-1]), int(0.8 * len(sets[-1])))) | {of + i} if i % 3 == 2 else own)
    return [(f"h{i:03}", f"n{j:04}") for i, own in enumerate(sets) for j in own]


@pytest.mark.parametrize(("large", "cell"), [(0, 64), (20, 512)])
@pytest.mark.parametrize("least", [0.3, 0.5, 0.75])
def test_sketches_lose_no_pair(spark, monkeypatch, large, cell, least):
    monkeypatch.setattr(graph, "LARGE", large)
    monkeypatch.setattr(graph, "CELL", cell)
    pairs = hubs(random.Random(8), 40, (1, 90), 150)
    near: dict = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    first: dict = {}
    for name in sorted(near):
        first.setdefault(frozenset(near[name]), name)
    names = sorted(first.values())
    want = {(a, b, round(len(near[a] & near[b]) / len(near[a] | near[b]), 6)) for a in names for b in names if a < b and len(near[a] & near[b]) >= least * len(near[a] | near[b])}
    got = [(r.a, r.b, r.similarity) for r in graph.neighbour_similarity(spark.createDataFrame(pairs, "src string, dst string"), least).collect()]
    assert set(got) == want and len(got) == len(want) and want


@pytest.mark.parametrize("neighbours", [(20, 60), (150, 200)])
def test_unlike_hubs_are_not_counted(spark, monkeypatch, neighbours):
    """Sketches rule out nearly all pairs of hubs that have a rare neighbour in common before all of their neighbours are joined."""
    kept, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    pairs = hubs(random.Random(4), 90, neighbours, 600)
    graph.neighbour_similarity(spark.createDataFrame(pairs, "src string, dst string"), 0.5).collect()
    counted = [df.where("x like 'h%'").count() for df in kept if {"x", "y", "met"} <= set(df.columns)]
    assert len(counted) == 1 and 30 <= counted[0] <= 100


def test_components_of_hubs(spark):
    pairs = [("hub", f"n{i:03}") for i in range(100)] + [(f"p{i:02}", f"p{i + 1:02}") for i in range(20)]
    got = {r["name"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "src string, dst string")).collect()}
    assert got == {"hub": "hub"} | {f"n{i:03}": "hub" for i in range(100)} | {f"p{i:02}": "p00" for i in range(21)}


def test_similarity_loses_no_pair(spark):
    """Every similar pair follows from the rows of classes: members by their representative, others by both of theirs."""
    pairs = [("a", "c"), ("b", "c"), ("d", "c"), ("d", "e"), ("x", "y"), ("z", "y"), ("z", "w"), ("u", "w"), ("u", "y"), ("v", "v2")]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    rows = [(r.a, r.b, r.similarity) for r in graph.neighbour_similarity(edges, 0.5).union(graph.same_neighbours(edges)).collect()]
    near: dict = {}
    for s, d in pairs:
        near.setdefault(s, set()).add(d)
        near.setdefault(d, set()).add(s)
    first = {n: min(m for m in near if near[m] == near[n]) for n in near}
    got = {frozenset((a, b)): s for a, b, s in rows}
    for a in near:
        for b in near:
            if a < b:
                want = len(near[a] & near[b]) / len(near[a] | near[b])
                found = 1.0 if first[a] == first[b] else got.get(frozenset((first[a], first[b])), 0.0)
                assert (want >= 0.5) == (found > 0) and (want < 0.5 or abs(found - want) < 1e-6)
                if first[a] == first[b]:
                    assert all(frozenset((first[n], n)) in got for n in (a, b) if first[n] != n)


def test_cuts_are_compressed_tables(spark):
    assert graph.cut(spark.range(5)).inputFiles()


def test_following_names_of_a_text(spark):
    docs = spark.createDataFrame([(1, "Ann met Bob Ray, then Ann and Cy"), (2, "Solo"), (3, "none"), (4, None)], "doc_id long, text string")
    got = sorted(graph.following(docs, "text").collect(), key=str)
    assert [(r.src, r.dst) for r in got] == [("Ann", "Bob Ray"), ("Bob Ray", "Cy"), ("Cy", None), ("Solo", None)]
    want = graph.co_mentions(graph.mentions(docs, "doc_id", "text"), "doc_id").select("src", "dst").collect()
    assert sorted(r for r in got if r.dst) == sorted(want)

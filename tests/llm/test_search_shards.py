"""Both searches over several shards and query blocks: ties, repeated ids, vectors of differing length, few candidates."""

import random

import pytest

from loam.llm import search


def brute(rows, k, scale=None):
    held = {}
    for i, v in rows:
        if v is not None and all(x is not None for x in v):
            held[i] = min(held.get(i, v), v)
    if scale is None:
        held = {i: v for i, v in held.items() if any(v)}
    value = (lambda x: x) if scale is None else (lambda x: int(x * scale // 1))
    out = []
    for q in sorted(i for i in held if i % 20 == 0):
        scored = sorted((-sum(value(a) * value(b) for a, b in zip(held[q], v)), i) for i, v in held.items() if i != q)
        out += [(q, rank, i, -score) for rank, (score, i) in enumerate(scored[:k], 1)]
    return out


@pytest.mark.parametrize("n", [3, 15, 90])
def test_searches_equal_brute_force(spark, monkeypatch, n):
    monkeypatch.setattr(search, "SHARD", 16)
    monkeypatch.setattr(search, "QUERIES", 2)
    r = random.Random(n)
    rows = [(i, [r.randint(-2, 2) / 2 for _ in range(r.choice([4, 4, 3]))]) for i in range(n)]
    rows += [(1, rows[1][1]), (2, [9.0, 0.0, 0.0, 0.0]), (500, None), (501, [1.0, None]), (520, [0.0, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, rank string, score int")
    key = lambda x: (x.query_id, x.rank)
    got = [tuple(x) for x in sorted(search.exact_top_k(frame, k=20).collect(), key=key)]
    assert got == brute(rows, 20, 64)
    got = [tuple(x) for x in sorted(search.approximate_top_k(frame, k=20, tables=2, probes=1).collect(), key=key)]
    assert got == brute(rows, 20)  # no shard holds more than the rows that are asked for

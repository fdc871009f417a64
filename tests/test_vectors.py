"""Nearest vectors against brute force: exact in every block size, learned cells by recall and by what they read."""

from __future__ import annotations

import re

import numpy as np
import pytest

from loam.operators import vectors as N
from loam.sources.scratch import Scratch

CLUSTERS = 24


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(CLUSTERS, 12))
    v = (centres[draw.integers(0, CLUSTERS, 1500)] + 0.4 * draw.normal(size=(1500, 12))).tolist()
    return list(enumerate(v)) + [(1500 + i, v[7]) for i in range(30)] + [(3, v[11])]  # copies, and an id twice


AWKWARD = [(9001, None), (9002, []), (9003, [0.0] * 12), (9004, [1.0] * 11), (9005, [float("nan")] + [1.0] * 11), (9006, [None] + [1.0] * 11), (9007, [float("inf")] + [1.0] * 11), (None, [1.0] * 12)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1.5) for i, v in rows], "id long, v array<double>, score double").repartition(3)


def plain(rows, queries, k, itself):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    ids, table = [i for i, _ in rows], np.array([unit(v) for _, v in rows])
    out = {}
    for i, v in queries:
        scores = np.round(table @ unit(v), 12)
        best = sorted((-s, j) for s, j in zip(scores, ids, strict=True) if itself or j != i)[:k]
        out[i] = [(j, round(-s, 9)) for s, j in best]
    return out


def by_query(out):
    found: dict = {}
    for r in out.orderBy("qid", "rank").collect():
        found.setdefault(r.qid, []).append((r.id, round(r.score, 9)))
    return found


@pytest.mark.parametrize(("k", "sent", "itself"), [(5, N.SENT, True), (40, 12 * 8 * 9, False)])
def test_exact_nearest(spark, rows, monkeypatch, k, sent, itself):
    monkeypatch.setattr(N, "SENT", sent)
    asked = [(i, v) for i, v in rows if i % 20 == 0]
    got = by_query(N.exact_nearest(frame(spark, rows + AWKWARD), frame(spark, asked + AWKWARD), k, itself))
    assert got == plain(rows, asked, k, itself)


def test_similar_rows(spark, rows):
    asked = rows[::50]
    got = sorted((r.qid, r.id) for r in N.similar_rows(frame(spark, rows + AWKWARD), frame(spark, asked), 0.9).collect())
    want = sorted((i, j) for i, v in asked for j, u in rows if i != j and np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v) >= 0.9)
    assert got == want and len(got) > 100


def test_cells(spark, rows):
    held = Scratch(spark)
    stored = N.write_cells(frame(spark, rows + AWKWARD), held, 10, 0.95, cells=32)
    table = spark.read.parquet(stored.path)
    assert stored.rows == table.count() == len(rows)  # every row is in the index, once
    asked = [(i, v) for i, v in rows if i % 20 == 0]
    out = N.nearest_in_cells(spark, stored, frame(spark, asked + AWKWARD), 10)
    got, want = by_query(out), plain(rows, asked, 10, False)
    recall = np.mean([len({j for j, _ in want[i]} & {j for j, _ in got[i]}) / 10 for i, _ in asked])
    assert recall >= 0.9 and stored.probes <= 16
    for i, found in got.items():  # scores are exact
        assert all(abs(dict(plain(rows, [(i, dict(asked)[i])], len(rows), False)[i])[j] - s) < 1e-8 for j, s in found[:3])
    one = N.nearest_in_cells(spark, stored, frame(spark, asked[:1]), 10, probes=1)
    assert re.search(r"PartitionFilters: \[[^\]]*cell#", one._jdf.queryExecution().executedPlan().toString())
    full = by_query(N.nearest_in_cells(spark, stored, frame(spark, asked), 10, probes=32))
    assert full == want  # all cells: exact
    held.drop_all()


def test_no_vectors(spark, rows):
    assert N.write_cells(frame(spark, AWKWARD[:3]), Scratch(spark)) is None
    assert N.exact_nearest(frame(spark, AWKWARD[:3]), frame(spark, rows[:3]), 5).count() == 0
    assert N.exact_nearest(frame(spark, rows), frame(spark, AWKWARD[:2]), 5).count() == 0

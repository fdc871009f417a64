"""Leader groups of like vectors against the plain loop."""

from __future__ import annotations

import numpy as np
import pytest

from loam.operators import redundancy as L


def plain(rows, least):
    """[(id, date or None, vector)] -> {id: leader}; newest first, ties by id, no date last."""
    ordered = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in ordered}
    group: dict = {}
    for n, (i, _, _) in enumerate(ordered):
        if i not in group:
            group[i] = i
            for j, _, _ in ordered[n + 1 :]:
                if j not in group and unit[i] @ unit[j] >= least:
                    group[j] = i
    return group


def frame(spark, rows):
    return spark.createDataFrame([(i, None if d is None else f"2024-01-01 00:{d // 60:02d}:{d % 60:02d}", v) for i, d, v in rows], "id long, at string, v array<double>").selectExpr("id", "cast(at as timestamp) as created_at", "v").repartition(3)


@pytest.mark.parametrize("members", [1024, 16])
def test_groups(spark, monkeypatch, members):
    monkeypatch.setattr(L, "MEMBERS", members)
    draw = np.random.default_rng(9)
    centres = draw.normal(size=(12, 16))
    rows = [(i, None if i % 17 == 0 else int(draw.integers(0, 300)), (centres[draw.integers(0, 12)] + draw.choice([0.05, 0.25, 0.4]) * draw.normal(size=16)).tolist()) for i in range(260)]
    chain = [np.cos(a) * np.eye(16)[0] + np.sin(a) * np.eye(16)[1] for a in np.arange(12) * 0.25]  # each like its neighbours only
    rows += [(1000 + n, 400 + int(draw.permutation(12)[0]) + n, v.tolist()) for n, v in enumerate(chain)]
    rows += [(2000 + n, n, rows[5][2]) for n in range(30)]  # copies of one vector
    awkward = [(3000, 5, None), (3001, 5, [0.0] * 16), (3002, 5, [1.0] * 3), (3003, 5, [float("nan")] * 16)]
    out = L.grouped_by_leader(frame(spark, rows + awkward), 0.95, 1e-7)
    got = {r.id: r.leader for r in out.collect()}
    want = plain(rows, 0.95)
    assert got == want and 12 < len(set(want.values())) < 150
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows}
    groups = {r.leader: r for r in L.redundant_groups(out).collect()}
    for leader, r in groups.items():
        others = [i for i in want if want[i] == leader and i != leader]
        assert r.members == len(others) + 1 and r.action == ("merge" if len(others) > 1 else "review")
        assert r.similarity == pytest.approx(np.mean([unit[i] @ unit[leader] for i in others]))
    assert groups.keys() == {x for x in want.values() if sum(y == x for y in want.values()) > 1}
    assert out.count() == len(rows)


def test_nothing_to_compare(spark):
    assert L.grouped_by_leader(frame(spark, [(1, 1, None), (2, 2, [0.0])])).count() == 0
    assert [tuple(r) for r in L.grouped_by_leader(frame(spark, [(1, 1, [2.0])])).collect()] == [(1, 1, 1.0)]

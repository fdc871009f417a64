"""Buckets are searched once for all rounds, and again only for classes whose list of newer ones alike was cut."""

import numpy as np
import pyarrow as pa
import pytest
from test_redundancy import frame, plain

from loam.operators import redundancy as L


@pytest.mark.parametrize(("named", "most"), [(8, 1), (1, 40)])
def test_rounds_share_one_search(spark, monkeypatch, named, most):
    monkeypatch.setattr(L, "NAMED", named, raising=False)
    searches = []
    monkeypatch.setattr(L, "MEMBERS", 16)
    chain = [np.cos(a) * np.eye(8)[0] + np.sin(a) * np.eye(8)[1] for a in np.arange(12) * 0.1]  # each like three before it
    rows = [(n, 100 - n, v.tolist()) for n, v in enumerate(chain)] + [(50 + n, n, np.eye(8)[n].tolist()) for n in range(2, 8)]
    search = L.searched
    monkeypatch.setattr(L, "searched", lambda *a: searches.append(1) or search(*a))
    got = {r.id: r.leader for r in L.grouped_by_leader(frame(spark, rows), 0.95, 1e-7).collect()}
    assert got == plain(rows, 0.95) and got[3] == 0 and got[4] == 4
    assert 1 <= len(searches) <= most and (named > 1 or len(searches) > 1)


@pytest.mark.parametrize("settled", [0, 40, 1 << 18])
def test_rounds_and_settling_at_once_agree(spark, monkeypatch, settled):
    monkeypatch.setattr(L, "SETTLED", settled)
    monkeypatch.setattr(L, "MEMBERS", 16)
    monkeypatch.setattr(L, "NAMED", 2)
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(6, 12))
    rows = [(i, int(draw.integers(0, 60)), (centres[draw.integers(0, 6)] + draw.choice([0.1, 0.3]) * draw.normal(size=12)).tolist()) for i in range(160)]
    assert {r.id: r.leader for r in L.grouped_by_leader(frame(spark, rows), 0.95, 1e-7).collect()} == plain(rows, 0.95)


def test_few_rows_need_no_rounds_and_few_searches(spark, monkeypatch):
    """A chain that joins and leads in turn took a round for each of its members, and a search for each list that was cut."""
    searches, written, search, write = [], [], L.searched, L.Scratch.write
    monkeypatch.setattr(L, "NAMED", 1)
    monkeypatch.setattr(L, "MEMBERS", 16)
    monkeypatch.setattr(L, "searched", lambda *a: searches.append(1) or search(*a))
    monkeypatch.setattr(L.Scratch, "write", lambda own, df, name: written.append(name) or write(own, df, name))
    chain = [np.cos(a) * np.eye(8)[0] + np.sin(a) * np.eye(8)[1] for a in np.arange(24) * 0.1]  # each like three before it
    rows = [(n, 100 - n, v.tolist()) for n, v in enumerate(chain)]
    assert {r.id: r.leader for r in L.grouped_by_leader(frame(spark, rows), 0.95, 1e-7).collect()} == plain(rows, 0.95)
    assert len(searches) <= 3 and "round" not in written


@pytest.mark.parametrize("named", [1, 3])
def test_a_list_ends_at_one_that_leads(named):
    """Rows 1 and 3 lead, all are alike: a list goes to the newest one that leads, which is no cut, or to as many as may be named."""
    half = np.ones(4, np.float16).tobytes()
    b = pa.RecordBatch.from_pydict({"bucket": [5] * 5, "age": list(range(5)), "id": list(range(5)), "open": [False, False, True, False, True], "leads": [False, True, False, True, False], "half": [half] * 5})
    got = [tuple(r.values()) for part in L.newest_alike(iter([b.slice(0, 2), b.slice(2)]), 0.95, named) for r in part.to_pylist()]
    assert got == [(u, *r) for u in (2, 4) for r in ([(0, 0, True, True)] if named == 1 else [(0, 0, True, False), (1, 1, True, False)])]

"""N-gram Jaccard join: sketches rule out no similar pair, and whole sets travel only for pairs that they leave."""

import numpy as np
import pyarrow as pa
import pytest

from loam.llm import jaccard


def drawn(r, n):
    return np.unique(jaccard.mix(r.integers(0, 1 << 62, n).astype(np.uint64)))


def changed(r, s, share):
    gone = r.random(len(s)) < share
    return np.unique(np.concatenate([s[~gone], drawn(r, int(gone.sum() * r.uniform(0, 1.5)))]))


def similar(a, b, percent):
    both = len(np.intersect1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)


@pytest.mark.parametrize("percent", [75, 30])
@pytest.mark.parametrize("sides", [(2, 2), (0, 1)])
def test_sketches_keep_every_similar_pair(percent, sides):
    r = np.random.default_rng(3)
    every = [drawn(r, int(n)) for n in r.choice([1, 2, 5, 31, 33, 60, 120, 250, 500, 1000, 2050], 60)]
    every = [s for s in every for s in (s, changed(r, s, r.uniform(0, 0.5)))]
    every = [s for s in every if len(s)]
    side = np.array([sides[i % 2] for i in range(len(every))], np.int32)
    keys = np.arange(len(every)) * jaccard.LEVELS
    cell = pa.table({
        "key": keys, "size": [len(s) for s in every], "side": side, "class": keys, "tokens": pa.nulls(len(every), pa.list_(pa.int64())),
        "sketch": pa.array([jaccard.sketch(s).tobytes() for s in every], pa.binary()),
    })
    found = jaccard.possible(cell, percent)
    wanted = np.zeros(len(every), bool)
    for i, a in enumerate(every):
        for j, b in enumerate(every):
            if i != j and (side[i], side[j]) in ((2, 2), (0, 1)) and similar(a, b, percent):
                wanted[i] = wanted[j] = True
    assert wanted.any() and found[wanted].all()
    if percent == 75:
        assert found.sum() < wanted.sum() + 0.2 * len(every)


def test_documents_far_from_all_keep_their_sets(spark, monkeypatch):
    """Documents are made of passages that others hold, too: tokens meet everywhere, but hardly a set needs to be sent."""
    r = np.random.default_rng(2)
    rows = [(i, " ".join(f"p{p}-{j}" for p in r.choice(60, 10, replace=False) for j in range(12))) for i in range(50)]
    rows += [(100, rows[0][1] + " more"), (101, rows[1][1])]
    sent, grouped = {"sketch": 0, "held": 0}, jaccard._grouped

    def counted(rows, held, to, *rest):
        sent[to] += rows.count()
        return grouped(rows, held, to, *rest)

    monkeypatch.setattr(jaccard, "_grouped", counted)
    got = jaccard.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i for i, _ in rows} | {100: 0, 101: 1}
    assert sent["sketch"] > 40 and sent["held"] <= 6


def test_sets_dealt_by_key_give_the_same_classes(spark, monkeypatch):
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(f"x{i}" if j == i or j == 50 else w for j, w in enumerate(base))) for i in range(0, 60, 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    listed = sorted(map(tuple, jaccard.similar_classes(frame).collect()))
    monkeypatch.setattr(jaccard, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, jaccard.similar_classes(frame).collect())) == listed


def test_planes_take_no_more_than_their_entropy():
    r = np.random.default_rng(5)
    x = r.geometric(1 / (1 << 15), 10_000)
    raw = jaccard.planes(x)
    assert (jaccard.unplaned(raw) == x).all() and len(raw) < 2.3 * len(x)  # 3 bytes each as they stand, 16.4 bits of entropy
    for n in (0, 1, 2, 255, 70_000):
        x = r.integers(0, 1 << 40, n)
        assert (jaccard.unplaned(jaccard.planes(x)) == x).all()

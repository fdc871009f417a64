"""Ranked lexical search against a plain score of every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from loam.llm import signatures

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def plain(documents, items, k):
    """[(item, rank, doc, score)] of [(id, text)] against [(item, text)]; rows without id come last in ties."""
    docs = [(i, Counter(terms(t))) for i, t in documents]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    count, total, df = len(docs), sum(n for _, _, n in docs), Counter(t for _, c, _ in docs for t in c)
    asked: dict = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        found = []
        for i, c, n in docs:
            m = 50 + 50 * n * count // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def found(spark, documents, items, **more):
    docs = spark.createDataFrame([(*d, 1) for d in documents], "doc_id long, text string, row int").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in signatures.top_documents(docs, asked, **more).collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(11)
    words = [f"w{i}" for i in range(300)] + ["École", "É", "ﬀ", "A", "a", "B1", "_x", "the"] * 4
    text = lambda n: "".join(draw.choice(words) + draw.choice([" ", ".", "-", "\n", " THE "]) for _ in range(n))
    docs = [(i, text(draw.choice([1, 5, 20, 60, 400]))) for i in range(400)]
    docs += [(400 + i, docs[7][1]) for i in range(70)] + [(3, docs[9][1]), (None, docs[7][1]), (None, docs[8][1]), (500, None), (501, ""), (502, " ..."), (503, "w1 " * 30_000 + "rareword")]
    items = [(i, docs[draw.randrange(400)][1][:300]) for i in range(12)] + [(20, "w1"), (21, "rareword w1 absent"), (22, "absent"), (23, None), (24, ""), (None, "w1"), (25, "w2"), (25, "w3 W2"), (26, " ".join(words))]
    return docs, items


@pytest.mark.parametrize(("k", "batch"), [(50, signatures.TERMS), (3, 40)])
def test_equals_plain_scores(spark, corpus, k, batch):
    assert found(spark, *corpus, k=k, batch=batch) == plain(*corpus, k)


def test_empty_tables(spark, corpus):
    docs, items = corpus
    assert found(spark, [], items) == [] and found(spark, docs[:5], []) == [] and found(spark, [(1, None)], items) == []


def test_bounds_are_above_scores_and_exclude():
    draw = np.random.default_rng(2)
    gathered, rows = signatures.Gathered(512), []
    for i in range(40):
        own = np.unique(draw.integers(0, 1 << 60, 20, dtype=np.uint64)[: draw.integers(1, 20)])
        tf = draw.integers(1, 12, len(own))
        rows.append((own, tf))
        gathered.add((i, i, int(tf.sum()), int(tf.max())), own, tf)
    block = gathered.block()
    wanted = np.concatenate([r[0][:2] for r in rows[:10]])
    queries = signatures.Queries(np.arange(len(wanted)) // 4, wanted.view(np.int64), draw.integers(1, 9000, len(wanted)), 40, int(sum(r[1].sum() for r in rows)))
    own = signatures.unpacked(block, 0)
    bound = queries.bounds(own["width"], own["bits"], own["n"], own["most"])
    exact = np.zeros_like(bound)
    for q in range(len(queries.items)):
        for x in range(queries.first[q], queries.first[q + 1]):
            for d, (t, tf) in enumerate(rows):
                exact[q, d] += sum(queries.weight[x] * signatures.gain(np.array([f]), queries.lengths(own["n"])[d])[0] for h, f in zip(t, tf, strict=True) if h == queries.term[x])
    assert (bound >= exact).all() and (bound == 0).mean() > 0.5 and (exact[exact > 0] * 1.5 > bound[exact > 0]).mean() > 0.8

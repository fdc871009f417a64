"""Text rank, keyword and hybrid search, and fuzzy deduplication against plain Python."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from loam.operators import retrieval as R


def tokens(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def wanted(text):
    return [t for t in dict.fromkeys(tokens(text)) if t not in R.STOP]


def covers(words, terms):
    """Shortest stretches that hold all terms, by trying every one."""
    at = [i for i, w in enumerate(words) if w in terms]
    full = [(a, b) for a in at for b in at if a <= b and {w for w in words[a : b + 1]} >= set(terms)]
    return [(a, b) for a, b in full if not any((c, d) != (a, b) and a <= c and d <= b for c, d in full)]


def plain_rank(text, terms):
    words = tokens(text)
    return sum(0.1 / (1 + (b - a + 1 - sum(w in terms for w in words[a : b + 1]))) for a, b in covers(words, terms))


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(8)
    docs = [(i, " ".join(draw.choice(["red", "green", "blue", "the", "x1", "Dog", "dog,", "É"]) for _ in range(draw.choice([0, 1, 3, 12, 40])))) for i in range(60)] + [(60, None), (61, "x1 " * 500 + "red")]
    queries = [(0, "red dog"), (1, "the"), (2, "blue"), (3, "red green blue dog x1"), (4, "missing red"), (5, None), (6, ""), (7, "Red RED dog")]
    return docs, queries


def frames(spark, corpus):
    docs, queries = corpus
    return spark.createDataFrame(docs, "id long, text string").repartition(3), spark.createDataFrame(queries, "qid long, text string")


def test_text_rank_and_keywords(spark, corpus):
    docs, queries = corpus
    want = {(q, i): plain_rank(t, wanted(x)) for q, x in queries for i, t in docs if wanted(x) and set(wanted(x)) <= set(tokens(t))}
    got = {(r.qid, r.id): r.text_rank for r in R.text_rank(*frames(spark, corpus)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got) and len(got) > 40
    assert {k: round(got[k] * 10) for k in got if k[0] == 2} == {(2, i): tokens(t).count("blue") for i, t in docs if "blue" in tokens(t)}
    assert {(r.qid, r.id) for r in R.keyword_matches(*frames(spark, corpus)).collect()} == want.keys()


def test_hybrid_scan(spark, corpus):
    draw = np.random.default_rng(1)
    docs, queries = corpus
    vec = {i: draw.normal(size=5) for i, _ in docs if i % 9}
    qvec = {q: draw.normal(size=5) for q, _ in queries}
    own = spark.createDataFrame([(i, t, vec[i].tolist() if i in vec else None) for i, t in docs], "id long, text string, v array<double>")
    asked = spark.createDataFrame([(q, t, qvec[q].tolist()) for q, t in queries], "qid long, text string, v array<double>")
    got: dict = {}
    for r in R.hybrid_scan(own, asked, 7).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.id, r.score))
    for q, x in queries:
        found = []
        for i, t in docs:
            terms = wanted(x)
            match = bool(terms) and set(terms) <= set(tokens(t))
            cos = float(vec[i] @ qvec[q] / np.linalg.norm(vec[i]) / np.linalg.norm(qvec[q])) if i in vec else 0.0
            if match or (i in vec and 1 - cos < 0.8):
                found.append((-round(0.7 * cos + 0.3 * (plain_rank(t, terms) if match else 0.0), 8), i))
        want = sorted(found)[:7]
        assert [i for _, i in want] == [i for i, _ in got.get(q, [])] and np.allclose([-s for s, _ in want], [s for _, s in got.get(q, [])])


def plain_fold(results):
    kept = []
    for i, score, text in results:
        words = set((text or "").lower().split())
        for u in kept:
            both = words | u[2]
            if (not both) or (words and u[2] and len(words & u[2]) / len(both) > 0.9):
                if score > u[1]:
                    kept.remove(u)
                    kept.append((i, score, words))
                break
        else:
            kept.append((i, score, words))
    return [(i, s) for i, s, _ in kept]


def test_fuzzy_deduplication(spark):
    draw, rows = random.Random(2), []
    base = [" ".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=30)) + f" t{i} " + " ".join(f"w{i}x{j}" for j in range(25)) for i in range(5)]
    for q in range(12):
        for place in range(14):
            text = draw.choice([*base, None, "", "one word", "ONE  word\\n"])
            if text in base and draw.random() < 0.5:
                text += draw.choice(["", " more", " more and more of it all", "\tA"])
            rows.append((q, place, 100 * q + place, draw.choice([0.1, 0.5, 0.5, 0.9]), text))
    out = R.deduplicated(spark.createDataFrame(rows, "qid long, place int, id long, score double, text string").repartition(5))
    got: dict = {}
    for r in out.orderBy("qid", "place").collect():
        got.setdefault(r.qid, []).append((r.id, r.score))
    want = {q: plain_fold([r[2:] for r in rows if r[0] == q]) for q in range(12)}
    assert got == want
    first_kept = {q: plain_fold([(i, 0.0, t) for _, _, i, _, t in (r for r in rows if r[0] == q)]) for q in range(12)}
    assert any([i for i, _ in first_kept[q]] != [i for i, _ in want[q]] for q in want)  # some were replaced

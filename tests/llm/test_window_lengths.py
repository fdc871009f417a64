"""Windows of every length that is allowed equal brute force; others are refused."""

import random
from collections import Counter

import pytest

from loam.llm import substrings


def brute(texts, length):
    words = [t.split() for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for j in range(i, i + length)}
        out.append(" ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("length", [6, 7, 35, 67, 68])
def test_lengths_equal_brute_force(spark, length):
    r = random.Random(length)
    shared = [f"s{r.randint(0, 500)}" for _ in range(300)]
    texts = []
    for i in range(12):
        a = r.randint(0, 120)
        texts.append(" ".join([*(f"d{i}w{j}" for j in range(20)), *shared[a : a + r.randint(length - 1, 150)], *(f"e{i}w{j}" for j in range(9))]))
    texts.append(" ".join(["x"] * 200))
    texts.append(" ".join(["y"] * length))
    got = {r.id: r.kept for r in substrings.keep_unrepeated(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), length).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


@pytest.mark.parametrize("length", [0, 5, 69, 80])
def test_other_lengths_are_refused(spark, length):
    with pytest.raises(ValueError):
        substrings.keep_unrepeated(spark.createDataFrame([(1, "x")], "id int, text string"), length)

"""Bin completion against the optimum of a plain search, and packing of repeated rows and clashing columns."""

import random
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

from loam.llm import packing


def optimum(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in {b for b in bins if b + items[i] <= capacity}:
            j = bins.index(room)
            bins[j] += items[i]
            go(i + 1, bins)
            bins[j] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_bin_completion_is_optimal_where_best_fit_is_not():
    r, better = random.Random(3), 0
    for _ in range(250):
        capacity = r.choice([20, 30, 50])
        items = [r.randint(capacity // 8, capacity // 2 + 3) for _ in range(r.randint(1, 12))]
        counts = Counter(items)
        found, used = packing.bin_completion(dict(counts), capacity), Counter()
        for held, n in found:
            assert sum(s * k for s, k in held.items()) <= capacity
            used.update({s: k * n for s, k in held.items()})
        assert used == counts
        bins = sum(n for _, n in found)
        assert bins == optimum(items, capacity), (items, capacity)
        better += bins < sum(n for _, n in packing.best_fit(dict(counts), capacity))
    assert better > 3


def test_many_pieces_reach_the_lower_bound():
    r = random.Random(1)
    counts = Counter(min(2048, int(r.lognormvariate(5.8, 1)) + 1) for _ in range(200_000))
    bound = packing.lower_bound(dict(counts), 2048)
    assert sum(n for _, n in packing.best_fit(dict(counts), 2048)) > bound
    assert sum(n for _, n in packing.bin_completion(dict(counts), 2048)) == bound


def test_fillings_are_maximal_and_undominated():
    left = {5: 1, 4: 1, 3: 2, 2: 1}
    got = [(dict(h), w) for h, w in packing.fillings([5, 4, 3, 2], left, 7, 7)]
    assert got == [({5: 1, 2: 1}, 0), ({4: 1, 3: 1}, 0)]
    assert packing.dominated({3: 1, 2: 1}, 0, [5, 3, 2], {5: 1, 3: 1, 2: 1})  # a 5 takes the place of 3 and 2
    assert not packing.dominated({5: 1}, 0, [5, 3, 2], {5: 1, 3: 1, 2: 1})


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "one two", 9, 9, 9), (1, "one two", 9, 9, 9), (2, None, 9, 9, 9), (2, "", 9, 9, 9), (None, "three", 9, 9, 9)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack(packing.pieces(spark.createDataFrame(rows, "doc_id long, text string, length int, piece int, sequence_id int"), path)).collect()
    library = Tokenizer.from_file(path)
    assert sorted(r.length for r in got) == sorted(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in rows)
    assert len({r.sequence_id for r in got}) == 1
    at = 0
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == at
        at += r.length

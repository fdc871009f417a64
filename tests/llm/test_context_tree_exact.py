"""The context tree against a plain one in dictionaries."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np

from loam.llm import context_tree


def plain(training):
    """{(context, bits): [zeros, ones]} and the log of every node's weighted probability."""
    n, children = defaultdict(lambda: [0, 0]), defaultdict(set)
    for text in training:
        data = b"\xff" * 5 + text + b"\xff"
        for i in range(5, len(data)):
            bits = f"{data[i]:08b}"
            for d in range(6):
                for j in range(8):
                    n[data[i - d : i], bits[:j]][int(bits[j])] += 1
                    if d:
                        children[data[i - d + 1 : i], bits[:j]].add((data[i - d : i], bits[:j]))
    kt = {k: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for k, (a, b) in n.items()}
    both = {}
    for k in sorted(n, key=lambda k: -len(k[0])):
        both[k] = kt[k] if len(k[0]) == 5 else float(np.logaddexp(kt[k], sum(both[c] for c in children[k])) - math.log(2))
    return n, kt, both


def score(text, n, kt, both):
    data, total = b"\xff" * 5 + text + b"\xff", 0.0
    for i in range(5, len(data)):
        bits = f"{data[i]:08b}"
        for j in range(8):
            p, left, own = 0.0, 1.0, 0.5
            for d in range(6):
                k = (data[i - d : i], bits[:j])
                if k not in n:
                    break
                own = (n[k][1] + 0.5) / (sum(n[k]) + 1)
                part = left * (1 if d == 5 else math.exp(kt[k] - math.log(2) - both[k]))
                p, left = p + part * own, left - part
            p = min(max(p + left * own, 1e-9), 1 - 1e-9)
            total += math.log10(p if bits[j] == "1" else 1 - p)
    return total


def test_every_context_has_its_own_node(spark):
    r = random.Random(2)
    rows = [(i, "".join(r.choice("abcdeé ") for _ in range(r.randint(0, 60)))) for i in range(80)] + [(80, None), (81, "zz top")]
    train = [(t or "").encode() for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    model = plain(train)
    block = context_tree.BLOCK_BYTES
    context_tree.BLOCK_BYTES = 1000  # several blocks
    try:
        got = {x.doc_id: x.score for x in context_tree.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        context_tree.BLOCK_BYTES = block
    for i, t in rows:
        assert math.isclose(got[i], score((t or "").encode(), *model), rel_tol=1e-6)


def test_more_contexts_than_slots_stay_apart():
    # a context that was never seen stays unseen, however many others were
    r = np.random.default_rng(0)
    keys = np.unique(r.integers(0, 1 << 48, 1 << 19, dtype=np.uint64))
    seen = r.random(len(keys)) < 0.9
    branches = context_tree.Branches(keys, seen.astype(np.int64))
    last = np.unique(keys[seen] >> np.uint64(8))
    _, weight = branches.model[5, 0]
    assert (weight >= 0).sum() == len(last)

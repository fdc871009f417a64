"""The conversation trie against plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from loam.llm import tries

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """[(conv_id, turn, role, text)] -> the nodes as tuples in the order of NAMES."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append(((t is not None, t or 0), hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), (r, x)))
    own = {c: [x[2] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    at, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            at[whole[:d]].append(c)
        ends[whole].append(c)
    out = []
    for k, members in at.items():
        below = [x for x in at if x[: len(k)] == k]
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in at) for x in below)
        saved = sum((len(at[x]) - 1) * len(x[-1][1]) for x in below if x)
        children = sum(len(x) == len(k) + 1 for x in below)
        listed = ",".join(map(str, sorted(ends.get(k, []))))
        out.append((min(members), len(k), min(at[k[:-1]]) if k else None, len(members), children, leaves, saved, hashlib.sha256(listed.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, cells):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    return sorted((tuple(r[n] for n in NAMES) for r in tries.conversation_trie(df, cells=cells).collect()), key=repr)


def talk(seed, n, most, hot=0.3):
    draw, rows = random.Random(seed), []
    for c in range(0, n * 37, 37):
        if draw.random() < hot:
            said = ["hello", "é", "again"]
        else:
            said = [draw.choice(["hello", "é", "b", "😀😀", ""]) for _ in range(draw.randrange(most))]
        rows += [(c, t, draw.choice(["user", None]) if i else "user", x) for i, (t, x) in enumerate(zip(range(5, 5 + len(said)), said, strict=True))]
    return rows


@pytest.mark.parametrize("cells", [1, 60, 1 << 20])
def test_random_conversations(spark, cells):
    rows = talk(cells, 120, 7)
    assert found(spark, rows, cells) == plain(rows)


def test_awkward_rows(spark):
    rows = [(None, 1, "user", "no conversation"), (0, None, "user", "first"), (0, 2, None, None), (0, 1, "user", "x"), (1, 3, "user", "tie"), (1, 3, "user", "tie"), (1, 3, "bot", "tie")]
    rows += [(7, 1, "user", "alone")] + [(250, i, "user", f"long {i}") for i in range(300)] + [(251, 1, "u", "only turn")] + [(-130, 1, "user", "negative"), (-100, 1, "user", "base")]
    assert found(spark, [r for r in rows if (r[0] or 0) >= 0], 1 << 20) == plain([r for r in rows if (r[0] or 0) >= 0])
    many = rows[:-2] + [(100 * i + 3, t, "user", "same") for i in range(60) for t in range(3)]
    assert found(spark, many, 1) == plain(many)  # equal conversations over many blocks, and every conversation without turns
    assert found(spark, [r for r in rows if r[0] is None], 1 << 20) == []


def test_blocks_recombine_at_every_size():
    """Blocks of blocks: the same nodes, whatever the size of a block."""
    import numpy as np

    draw = random.Random(3)
    paths = sorted((tuple(draw.randrange(3) for _ in range(draw.randrange(6))), i) for i in range(400))
    counts = np.array([len(p) for p, _ in paths])
    ids = np.array([[0, x] for p, _ in paths for x in p], np.uint64).reshape(-1, 2)
    chars = np.array([7 + x for p, _ in paths for x in p], np.int64)
    rows = tries.members(counts, ids, chars, np.array([i for _, i in paths]))
    nodes = []
    for cells in (1, 40, 300, 1 << 20):
        nodes.append(sorted(x for own in tries.combined(rows, cells)[0] for x in zip(*(own[k].tolist() for k in ("least", "depth", "parent", "n", "children", "leaves", "saved")), strict=True)))
    assert nodes[0] == nodes[1] == nodes[2] == nodes[3] and len(nodes[0]) > 100

"""Context-tree weighting over binary-decomposed bytes, and a smoothed word count beside it.

The tree has a node for every context of 0 to `depth` preceding bytes that occurs and every prefix of the
next byte's bits; each node keeps how often a 0 and a 1 followed. Nodes are keyed by their whole context,
so the model grows with the corpus and no two contexts share one. Blocks of texts count their distinct byte
n-grams; these are summed in buckets by the three nearest context bytes, which hold the whole tree below
those bytes. Only the nodes of up to two context bytes, which the bytes bound, are summed over all buckets
and sent back. Every bucket then answers the n-grams of every block, as it does the words.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, written
from .text import U, each, flat, mix, slices

DEPTH = 5  #: preceding bytes of the longest context
TOP = 2  #: depth of the deepest nodes that are summed over all buckets
SLOTS = (8, 16, 19, 20, 21, 21)  #: bits of the number of nodes of each depth in tables (see `weigh`), which only tests use
EDGE = 0xFF  #: stands before and after every text; UTF-8 never has it
CHUNK = 4 << 20
BLOCK_BYTES = 8 << 20  #: text of a block, in which words and n-grams are looked up together
_STARTS = np.cumsum([0, *(1 << b for b in SLOTS)])


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in no particular order, index of every key among them)."""
    bits = 21
    slot = ((keys * U(0x9E3779B97F4A7C15)) >> U(64 - bits)).astype(np.int64)
    table, used = np.empty(1 << bits, U), np.zeros(1 << bits, bool)
    table[slot] = keys
    used[slot] = True
    index = np.cumsum(used)[slot] - 1
    values = table[used]
    lost = np.flatnonzero(values[index] != keys)
    if len(lost):
        more, back = np.unique(keys[lost], return_inverse=True)
        index[lost] = len(values) + back
        values = np.concatenate([values, more])
    return values, index


def grams(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(depth + 1 bytes up to each byte of every text and its end, first one of each row and the end)."""
    n = np.diff(rows)
    out = np.full(len(data) + len(n) * (DEPTH + 1), EDGE, np.uint8)
    # each row: DEPTH edges before, its bytes, one edge after
    at = np.arange(len(data)) + np.repeat(np.arange(len(n)) * (DEPTH + 1) + DEPTH, n)
    out[at] = data
    wide = out.astype(U)
    keys = np.zeros(len(out) - DEPTH, U) if len(out) else np.zeros(0, U)
    for i in range(DEPTH + 1):
        keys = (keys << U(8)) | wide[i : i + len(keys)]
    first = rows + np.arange(len(rows)) * (DEPTH + 1)  # start of each row in out
    own = np.ones(len(keys), bool)
    for i in range(DEPTH):  # n-grams that end in the edges before a text belong to none
        skip = first[1:-1] - DEPTH + i
        own[skip[skip >= 0]] = False
    return keys[own], rows + np.arange(len(rows))


def contexts(keys: np.ndarray) -> list[np.ndarray]:
    """Of every depth a scramble of the bytes before the last one."""
    out = []
    for depth in range(DEPTH + 1):
        context = (keys >> U(8)) & U((1 << (8 * depth)) - 1)
        out.append(context << U(8) if depth < 2 else mix(context * U(0xD6E8FEB86659FD93) + U(depth)))
    return out


def nodes(context: np.ndarray, keys: np.ndarray, depth: int, bit: int) -> np.ndarray:
    """The slot, over all tables, of the node that predicts bit 7 - `bit` of the last byte after that context."""
    node = (U(1) << U(bit)) | ((keys & U(255)) >> U(8 - bit))
    if depth < 2:
        slot = context | node
    else:
        slot = ((context ^ (node * U(0x9E3779B97F4A7C15))) * U(0xC2B2AE3D27D4EB4F)) >> U(64 - SLOTS[depth])
    return slot.astype(np.int64) + _STARTS[depth]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight, for x >= 0.5."""
    shift = np.ones_like(x)
    for i in range(8):
        shift = shift * (x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def weigh(zeros: np.ndarray, ones: np.ndarray, parents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of a 1, weight of the node's own estimate) of all nodes; weight -1: never seen.

    parents: of each node beyond depth 0 the slot of the node with one context byte less.
    """
    size = len(zeros)
    chance, weight, below = np.empty(size, np.float32), np.empty(size, np.float32), None
    for d in range(DEPTH, -1, -1):  # one depth at a time, which bounds what is held
        at = slice(_STARTS[d], _STARTS[d + 1])
        n0, n1 = zeros[at].astype(np.float64), ones[at].astype(np.float64)
        seen = n0 + n1 > 0
        chance[at] = (n1 + 0.5) / (n0 + n1 + 1)
        kt = np.zeros(len(n0))
        n0, n1 = n0[seen], n1[seen]
        kt[seen] = log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1) - math.log(math.pi)
        both = kt if below is None else np.logaddexp(kt, below) - math.log(2)
        weight[at] = np.where(seen, 1.0 if below is None else np.exp(kt - math.log(2) - both), -1)
        if d:
            up = parents[at][seen].astype(np.int64) - _STARTS[d - 1]
            below = np.bincount(up, weights=both[seen], minlength=1 << SLOTS[d - 1])
    return chance, weight


def log_probability(keys: np.ndarray, chance: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """log10 of the probability of the last byte of every n-gram after the others."""
    total, before = np.zeros(len(keys)), contexts(keys)
    for bit in range(8):
        one = (keys >> U(7 - bit)) & U(1) == 1
        p, left, open_ = np.zeros(len(keys)), np.ones(len(keys)), np.ones(len(keys), bool)
        own = np.full(len(keys), 0.5)
        for d in range(DEPTH + 1):
            at = nodes(before[d], keys, d, bit)
            w = weight[at]
            open_ &= w >= 0  # below a context that was never seen, its parent's estimate holds
            own = np.where(open_, chance[at], own)
            part = left * np.where(open_, w, 0)
            p += part * own
            left -= part
        p = np.clip(p + left * own, 1e-9, 1 - 1e-9)
        total += np.log10(np.where(one, p, 1 - p))
    return total


def turned(keys: np.ndarray) -> np.ndarray:
    """The n-grams with their context bytes nearest first, so that every context is a prefix; the last byte stays."""
    out = keys & U(255)
    for d in range(1, DEPTH + 1):
        out |= ((keys >> U(8 * d)) & U(255)) << U(8 * (DEPTH + 1 - d))
    return out


def block_grams(column, train: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Distinct turned n-grams of a block by bucket, their training counts, the first one of each bucket, and slice by slice the index of every n-gram and the first of every row."""
    data, offsets = flat(column)
    parts = []
    for a, b in slices(offsets, CHUNK):
        keys, at = grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        k, back = distinct(keys)
        parts.append((k, np.bincount(back, weights=np.repeat(train[a:b], np.diff(at)), minlength=len(k)), back.astype(np.int32), at))
    values, place = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
    n = np.bincount(place, weights=np.concatenate([x[1] for x in parts])).astype(np.int64)
    keys = turned(values)
    bucket = (mix(keys >> U(8 * (DEPTH - TOP))) % U(buckets)).astype(np.int64)
    order = np.lexsort((keys, bucket))
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    ends = np.cumsum([0, *(len(x[0]) for x in parts)])
    return keys[order], n[order], np.searchsorted(bucket[order], np.arange(buckets + 1)), [(rank[place[a:b]][x[2]], x[3]) for x, a, b in zip(parts, ends, ends[1:], strict=False)]


def packed(keys: np.ndarray) -> bytes:
    """48-bit keys byte by byte, which compresses well."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(6, -1).T
    return out.view("<u8").ravel()


def estimate(n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability of a 1, weight of the own estimate, log of the weighted probability) of nodes; weight -1: never seen."""
    kt = log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1) - math.log(math.pi)
    both = kt if below is None else np.logaddexp(kt, below) - math.log(2)
    own = np.ones(len(kt)) if below is None else np.exp(kt - math.log(2) - both)
    return (n1 + 0.5) / (n0 + n1 + 1), np.where(n0 + n1 > 0, own, -1), np.where(n0 + n1 > 0, both, 0)


class Branches:
    """The nodes of more than TOP context bytes below the contexts of sorted distinct turned n-grams."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        n = n.astype(np.float64)
        self.entries, self.up, counts = {DEPTH: keys}, {}, {DEPTH: n}
        for d in range(DEPTH - 1, TOP - 1, -1):  # the same n-grams with one context byte less
            e = self.entries[d + 1]
            self.entries[d], self.up[d + 1] = np.unique(((e >> U(16)) << U(8)) | (e & U(255)), return_inverse=True)
            counts[d] = np.bincount(self.up[d + 1], weights=counts[d + 1])
        self.index, self.model, tops = {}, {}, []
        for bit in range(8):
            below = first = None
            for d in range(DEPTH, TOP - 1, -1):
                e = self.entries[d]
                node = ((e >> U(8)) << U(bit)) | ((e & U(255)) >> U(8 - bit))
                new = np.append(True, node[1:] != node[:-1])
                index, start = np.cumsum(new) - 1, np.flatnonzero(new)
                if below is not None:
                    below = np.bincount(index[self.up[d + 1][first]], weights=below, minlength=len(start))
                ones = np.add.reduceat(np.where((e >> U(7 - bit)) & U(1) == 1, counts[d], 0), start)
                zeros = np.add.reduceat(counts[d], start) - ones
                if d == TOP:
                    tops.append(((e[start] >> U(8)) << U(8) | U(1 << bit) | ((e[start] & U(255)) >> U(8 - bit)), zeros, ones, below))
                else:
                    chance, weight, below = estimate(zeros, ones, below)
                    self.index[d, bit], self.model[d, bit], first = index, (chance, weight), start
        self.tops = [np.concatenate(x) for x in zip(*tops, strict=True)]  # node keys of depth TOP, zeros, ones, log probability below

    def log_probability(self, crown: Crown) -> np.ndarray:
        """log10 of the probability of the last byte of every n-gram after the others."""
        total = np.zeros(len(self.entries[DEPTH]))
        for bit in range(8):
            e = self.entries[TOP]
            p, left, own, open_ = np.zeros(len(e)), np.ones(len(e)), np.full(len(e), 0.5), np.ones(len(e), bool)
            for d in range(DEPTH + 1):
                if d <= TOP:
                    chance, weight = crown.at(d, e, bit)
                else:
                    p, left, own, open_ = (x[self.up[d]] for x in (p, left, own, open_))
                    chance, weight = (x[self.index[d, bit]] for x in self.model[d, bit])
                open_ &= weight >= 0  # below a context that was never seen, its parent's estimate holds
                own = np.where(open_, chance, own)
                part = left * np.where(open_, weight, 0)
                p, left = p + part * own, left - part
            p = np.clip(p + left * own, 1e-9, 1 - 1e-9)
            total += np.log10(np.where((self.entries[DEPTH] >> U(7 - bit)) & U(1) == 1, p, 1 - p))
        return total


class Crown:
    """The nodes of up to TOP context bytes, from the summed ones of depth TOP."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        self.model = {}
        for d in range(TOP, -1, -1):
            chance, weight, both = estimate(zeros, ones, below)
            self.model[d] = (keys, chance, weight)
            if d:
                keys, back = np.unique(((keys >> U(16)) << U(8)) | (keys & U(255)), return_inverse=True)
                zeros, ones, below = (np.bincount(back, weights=x, minlength=len(keys)) for x in (zeros, ones, both))

    def at(self, d: int, entries: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
        """(probability of a 1, weight) of the nodes of depth d that predict a bit of the n-grams with TOP context bytes."""
        keys, chance, weight = self.model[d]
        node = ((entries >> U(8 * (TOP - d + 1))) << U(8)) | U(1 << bit) | ((entries & U(255)) >> U(8 - bit))
        i = np.searchsorted(keys, node)
        return chance[i], weight[i]


def merged(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums by key, always in the same order."""
    order = np.lexsort((values[-1], keys))
    keys, back = np.unique(keys[order], return_inverse=True)
    return keys, *(np.bincount(back, weights=x[order], minlength=len(keys)) for x in values)


def crown(tops: DataFrame) -> Crown:
    """tops: packed nodes of depth TOP of every bucket; they are added up by the nearest byte."""
    schema = "byte int, " + ", ".join(f"c{i} binary" for i in range(4))

    def rows(parts):
        keys = parts[0]
        cuts = np.searchsorted(keys >> U(8 * TOP), np.arange(257))
        full = np.flatnonzero(np.diff(cuts))
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array([x[cuts[i] : cuts[i + 1]].tobytes() for i in full], pa.binary()) for x in parts)], names=["byte", "c0", "c1", "c2", "c3"])

    def split(batches):
        for batch in batches:
            for raw in batch.column("tops"):
                n = len(raw.as_py()) // 32
                yield rows(merged(np.frombuffer(raw.as_py(), U, n), *np.frombuffer(raw.as_py(), np.float64, offset=8 * n).reshape(3, n)))

    def add(key, table):
        parts = [np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column(f"c{i}")]) for i, kind in enumerate((U, float, float, float))]
        return pa.Table.from_batches([rows(merged(*parts))])

    got = tops.mapInArrow(split, schema).groupBy("byte").applyInArrow(add, schema).collect()
    return Crown(*merged(*(np.concatenate([np.zeros(0, kind), *(np.frombuffer(bytes(r[f"c{i}"]), kind) for r in got)]) for i, kind in enumerate((U, float, float, float)))))


def scores(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Rows whose crc32(doc_id as text) mod 10 is 0 are held out; the model and the counts come from all
    others. Null counts as the empty text, which still has its end. Repeated rows count as often as they
    stand; an empty table gives no rows; with no training row every token is unknown and every bit even.
    """
    spark = lean(documents.sparkSession)
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False)))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n_blocks = max(1, size // BLOCK_BYTES)
    blocks = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(n_blocks)).cast("int"))
    buckets = 4 * n_blocks
    gram_buckets = max(12, 2 * n_blocks)

    def local(table):
        """Distinct word hashes of a block, their training counts, and the index of every word."""
        held = table.column("held_out").to_numpy()
        words, first = [], [np.zeros(1, np.int64)]
        for _, _, _, _, _, h, f in each(table.column("text"), lower=True):
            first.append(f[1:] + first[-1][-1])
            words.append(h)
        first = np.concatenate(first)
        words = np.concatenate(words) if words else np.zeros(0, U)
        # the end of a text is a token too; no word hashes to 0 but by chance
        ends, inverse = np.unique(words, return_inverse=True)
        row_train = np.repeat(~held, np.diff(first))
        return ends, inverse, np.bincount(inverse, weights=row_train, minlength=len(ends)).astype(np.int64), first

    def count(key, table):
        values, _, train, _ = local(table)
        bucket = (values % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cuts))
        own = [order[cuts[i] : cuts[i + 1]] for i in full]
        yield pa.RecordBatch.from_arrays([pa.array([False] * len(full)), pa.array([key[0].as_py()] * len(full), pa.int32()), pa.array(full, pa.int32()), pa.array([values[o].tobytes() for o in own], pa.binary()), pa.array([train[o].astype(np.uint32).tobytes() for o in own], pa.binary())], ["gram", "block", "bucket", "words", "counts"])
        keys, n, cuts, _ = block_grams(table.column("text"), ~table.column("held_out").to_numpy(), gram_buckets)
        full = np.flatnonzero(np.diff(cuts))
        own = [slice(cuts[i], cuts[i + 1]) for i in full]
        yield pa.RecordBatch.from_arrays([pa.array([True] * len(full)), pa.array([key[0].as_py()] * len(full), pa.int32()), pa.array(full, pa.int32()), pa.array([packed(keys[o]) for o in own], pa.binary()), pa.array([n[o].astype(np.uint32).tobytes() for o in own], pa.binary())], ["gram", "block", "bucket", "words", "counts"])

    def counted(key, table):
        return pa.Table.from_batches(list(count(key, table)))

    looked_up = [("block", pa.int32()), ("bucket", pa.int32()), ("totals", pa.binary()), ("wide", pa.bool_()), ("n", pa.int64()), ("v", pa.int64())]
    summed = pa.schema([*looked_up, ("keys", pa.binary()), ("counts", pa.binary()), ("tops", pa.binary()), ("blocks", pa.list_(pa.int32())), ("ends", pa.list_(pa.int64())), ("places", pa.binary())])

    def add(key, table):
        counts = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("counts")])
        if key[0].as_py():  # n-grams: one row with those of the bucket and where each block's stand among them
            grams_ = [unpacked(x.as_py()) for x in table.column("words")]
            keys, back = np.unique(np.concatenate(grams_), return_inverse=True)
            total = np.bincount(back, weights=counts).astype(np.int64)
            row = {"bucket": key[1].as_py(), "keys": packed(keys), "counts": total.tobytes(), "tops": b"".join(x.tobytes() for x in Branches(keys, total).tops)}
            row |= {"blocks": table.column("block").to_pylist(), "ends": np.cumsum([len(x) for x in grams_]).tolist(), "places": back.astype(np.uint32).tobytes()}
            return pa.Table.from_pylist([row], summed)
        words = [np.frombuffer(x.as_py(), U) for x in table.column("words")]
        _, back = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(back, weights=counts).astype(np.int64)
        cuts = np.append(0, np.cumsum([len(w) for w in words]))
        n, v = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        n[0], v[0] = total.sum(), (total > 0).sum()  # once for the bucket
        kind = np.uint32 if total.max() < 1 << 32 else np.uint64
        own = {"block": table.column("block"), "bucket": table.column("bucket"), "totals": pa.array([total[back[a:b]].astype(kind).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()), "wide": pa.array([kind is np.uint64] * len(words)), "n": pa.array(n), "v": pa.array(v)}
        return pa.table([own[f.name] if f.name in own else pa.nulls(len(words), f.type) for f in summed], schema=summed)

    answer = pa.schema([*looked_up, ("logs", pa.binary())])

    def answered(batches):
        """Word counts as they are; of n-grams, for each block their probabilities."""
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in summed.names}
                if row["keys"] is None:
                    yield pa.RecordBatch.from_pylist([{f: row.get(f) for f in answer.names}], answer)
                    continue
                logs = Branches(unpacked(row["keys"]), np.frombuffer(row["counts"], np.int64)).log_probability(model.value).astype(np.float32)
                places = np.frombuffer(row["places"], np.uint32)
                yield pa.RecordBatch.from_pylist([{"block": k, "bucket": row["bucket"], "n": 0, "v": 0, "logs": logs[places[a:b]].tobytes()} for k, a, b in zip(row["blocks"], [0, *row["ends"]], row["ends"], strict=False)], answer)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "part", "score", "n", "v"]

    def score(key, table, found):
        values, inverse, _, first = local(table)
        totals, bucket = np.zeros(len(values), np.int64), (values % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        keys, _, own, parts = block_grams(table.column("text"), np.zeros(table.num_rows), gram_buckets)
        chances = np.zeros(len(keys))
        for i, x, wide, y in zip(found.column("bucket").to_pylist(), found.column("totals"), found.column("wide").to_pylist(), found.column("logs"), strict=True):
            if y.is_valid:
                chances[own[i] : own[i + 1]] = np.frombuffer(y.as_py(), np.float32)
                continue
            totals[order[cuts[i] : cuts[i + 1]]] = np.frombuffer(x.as_py(), np.uint64 if wide else np.uint32)
        logs = np.append(0, np.cumsum(np.log10(totals + 0.1)[inverse]))
        known = np.append(0, np.cumsum((totals > 0)[inverse]))
        out = [np.add.reduceat(chances[at], first_[:-1]) for at, first_ in parts]
        rows = table.num_rows
        columns = [table.column("doc_id").combine_chunks(), table.column("held_out").combine_chunks(), pa.array(np.diff(first) + 1), pa.array(np.diff(known[first])), pa.array(np.diff(logs[first])), pa.array(np.concatenate(out)), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64())]
        summed = [pa.nulls(1, f) for f in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())] + [pa.array([sum(found.column(c).to_pylist())], pa.int64()) for c in ("n", "v")]
        return pa.concat_tables([pa.table(columns, names=names), pa.table(summed, names=names)])

    looked = blocks.groupBy("block").applyInArrow(counted, "gram boolean, block int, bucket int, words binary, counts binary")
    schema = "block int, bucket int, totals binary, wide boolean, n long, v long"
    looked = written(looked.groupBy("gram", "bucket").applyInArrow(add, f"{schema}, keys binary, counts binary, tops binary, blocks array<int>, ends array<long>, places binary"), "context-tree-counts")
    model = spark.sparkContext.broadcast(crown(looked.where("tops is not null").select("tops")))
    looked = looked.mapInArrow(answered, f"{schema}, logs binary")
    result = blocks.groupBy("block").cogroup(looked.groupBy("block")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, part double, score double, n long, v long")
    result = written(result, "context-tree-scores")
    sums = result.agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.count_if(~F.col("held_out")).alias("ends")).first()
    ends = sums["ends"] or 0
    n, v = (sums["n"] or 0) + ends, (sums["v"] or 0) + (ends > 0)
    scale = math.log10(n + 0.1 * (v + 1))
    known = F.col("n_known") + F.lit(int(ends > 0))
    base = F.col("part") + F.lit(math.log10(ends + 0.1)) - F.col("n_tokens") * F.lit(scale)
    return result.where("n_tokens is not null").select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")

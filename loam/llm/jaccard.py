"""N-gram Jaccard join with adaptive multi-match prefixes; links and their classes.

A document's set holds the 64-bit hashes of its distinct k-word shingles. Its tokens are these hashes cut
to a length that grows with the corpus; hashes that fall together take the next free number, which never
makes two sets share less. Tokens are ordered by the number of documents that hold them, counted exactly,
rarest first. If two sets reach the similarity, the prefixes of both for a level e (size - least overlap
+ e tokens) share at least e tokens. Each document picks its own level by estimated cost: deeper levels
send more tokens, but demand more shared tokens before a pair is verified; a pair is held to the smaller
level of its two documents. Tokens of one document only are counted, but never sent on.

Pairs of a token's documents are never listed. Two rounds compare them with one hub per token, the
document with the most shared tokens; classes come from the links found. Tokens whose documents are still
in different classes are left to cells: documents of a family (those that share a hub) fall into blocks of
a bounded size, and two blocks that share a token meet in one group of a task, where pairs of different
classes, similar sizes and enough shared prefix tokens are compared. Sketches of about two to four bits a
shingle are compared first; they bound the difference of two sets from below, and only the documents of
pairs that it does not rule out come with their whole sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, Scratch, components, lean, small, written
from .text import U, each, mix

LEVELS = 8  #: prefix levels, held in the low three bits of a key
BLOCK = 1 << 20  #: shingles that are counted together before they leave a task
COMMON = 32  #: a token of more documents of one block is sent once for all of them
CELL = 100_000  #: shingles of the documents of one side of a cell, about
_ALL = 0xFFFF  #: in place of a document's number: all documents of the block that hold the token
_ZSTD = pa.Codec("zstd", 1)
_WIDE = np.array([0x9E3779B97F4A7C15 * (2 * i + 3) % (1 << 64) for i in range(64)], U)
_SENT = "kind int, bucket int, block long, doc_id long, n_shingles long, key long, h long, a binary, b binary, c binary"


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; shorter sequences count whole, none give none."""
    n = len(words)
    if not n:
        return np.zeros(0, U)
    width = min(k, n)
    out = np.full(n - width + 1, width, U)
    for i in range(width):
        out += words[i : n - width + 1 + i] * _WIDE[i]
    return np.unique(mix(out))


def sets(column: pa.Array, k: int):
    for a, b, _, _, _, words, first in each(column, lower=True):
        for row in range(a, b):
            yield row, shingles(words[first[row - a] : first[row - a + 1]], k)


def signature(s: np.ndarray) -> int:
    """The key of a set, without its level."""
    return int(mix(s + U(1)).sum(dtype=U) & ~U(LEVELS - 1)) if len(s) else 0


def tokens(s: np.ndarray, bits: int) -> np.ndarray:
    """The sorted hashes cut to `bits` bits; equal ones move to the next free number (as in linear probing)."""
    place = np.arange(len(s))
    return np.maximum.accumulate((s >> U(64 - bits)).astype(np.int64) - place) + place


def least(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def level(n: int, df: np.ndarray, percent: int) -> tuple[int, int]:
    """(level, number of shared tokens in its prefix) of a set of n tokens, of which those shared with other
    documents have the ascending frequencies df: the level with the least estimated cost of tokens sent and
    pairs verified."""
    base, alone = n - least(n, percent), n - len(df)
    levels = np.arange(1, max(1, min(LEVELS, least(n, percent))) + 1)
    sent = np.clip(base + levels - alone, 0, len(df))
    met = np.append(0, np.cumsum(df - 1.0))[sent]
    best = int(np.argmin(sent + met / levels * (4 + n / 20)))
    return int(levels[best]), int(sent[best])


def planes(x: np.ndarray) -> bytes:
    """Unsigned numbers as planes of bytes, lowest first, each compressed on its own where that makes it smaller."""
    x = x.astype(U)
    need = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    out = [bytes([need]), len(x).to_bytes(4, "little")]
    for plane in x.view(np.uint8).reshape(-1, 8)[:, :need].T:
        held = _ZSTD.compress(plane.tobytes(), asbytes=True)
        held = held if len(held) < len(x) else plane.tobytes()
        out += [len(held).to_bytes(4, "little"), held]
    return b"".join(out)


def unplaned(raw: bytes) -> np.ndarray:
    n, at = int.from_bytes(raw[1:5], "little"), 5
    out = np.zeros((n, 8), np.uint8)
    for i in range(raw[0]):
        size = int.from_bytes(raw[at : at + 4], "little")
        held = raw[at + 4 : at + 4 + size]
        out[:, i] = np.frombuffer(held if size == n else _ZSTD.decompress(held, n, asbytes=True), np.uint8)
        at += 4 + size
    return out.view(U).ravel()


def rising(x: np.ndarray) -> bytes:
    return planes(np.diff(x.astype(np.int64), prepend=0))


def risen(raw: bytes) -> np.ndarray:
    return np.cumsum(unplaned(raw).astype(np.int64))


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x).astype(np.int64, copy=False) if np.asarray(x).dtype != U else x.view(np.int64))


def _rows(n: int, **columns) -> pa.RecordBatch:
    """Rows of _SENT; columns that aren't given are null."""
    kinds = [("kind", pa.int32()), ("bucket", pa.int32()), *((c, pa.int64()) for c in ("block", "doc_id", "n_shingles", "key", "h")), *((c, pa.binary()) for c in "abc")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in kinds], [c for c, _ in kinds])


class Block:
    """Distinct sets of one task, until they are many enough to be sorted and sent."""

    def __init__(self, number: int):
        self.number, self.of, self.held, self.total = number, {}, [], 0

    def add(self, key: int, s: np.ndarray, bits: int) -> None:
        if key not in self.of:
            self.of[key] = len(self.of)
            self.held.append(tokens(s, bits))
            self.total += len(s)

    def full(self, most: int) -> bool:
        return self.total >= most or len(self.of) >= _ALL - 1

    def sent(self, bits: int, parts: int, common: int):
        """Kind 1: a bucket's tokens, each with its document's number and 1, or with _ALL and how many of the block
        hold it; kind 2: keys and sizes of the documents, and which ones hold the common tokens."""
        sizes = np.array([len(t) for t in self.held])
        t, doc = np.concatenate(self.held), np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(t, kind="stable")
        t, doc = t[order], doc[order]
        head = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        width = np.diff(np.append(head, len(t)))
        many = width > common
        inside = np.repeat(many, width)
        own = np.concatenate([[many.sum()], t[head[many]], width[many], doc[inside]]).astype(np.int64)
        keep = ~inside
        keep[head] = True
        doc, n = np.where(inside, _ALL, doc)[keep], np.ones(len(t), np.int64)
        n[head] = np.where(many, width, 1)
        t, n = t[keep], n[keep]
        bucket = np.minimum((t * (parts / (1 << bits))).astype(np.int64), parts - 1)
        cuts = np.searchsorted(bucket, np.arange(parts + 1))
        for i in np.flatnonzero(np.diff(cuts)):
            x = slice(cuts[i], cuts[i + 1])
            yield _rows(1, kind=[1], bucket=[int(i)], block=[self.number], a=[rising(t[x])], b=[planes(doc[x])], c=[planes(n[x])])
        yield _rows(1, kind=[2], bucket=[self.number % parts], block=[self.number], a=[np.array(list(self.of), U).tobytes()], b=[planes(sizes)], c=[own.tobytes()])


def _count(key, table):
    """Of a bucket's tokens those that more than one document holds, with their number; other rows as they are."""
    sent = pa.array(np.equal(table.column("kind").to_numpy(), 1))
    rest, rows = table.filter(pa.array(~sent.to_numpy(zero_copy_only=False))), table.filter(sent)
    if not rows.num_rows:
        return rest
    t, doc, n = ([f(x.as_py()) for x in rows.column(c)] for c, f in (("a", risen), ("b", unplaned), ("c", unplaned)))
    cuts = np.append(0, np.cumsum([len(x) for x in t]))
    every = np.concatenate(t)
    order = np.argsort(every, kind="stable")
    head = np.flatnonzero(np.append(True, every[order][1:] != every[order][:-1]))
    df = np.zeros(len(every), np.int64)
    df[order] = np.repeat(np.add.reduceat(np.concatenate(n)[order].astype(np.int64), head), np.diff(np.append(head, len(every))))
    out = []
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        keep = df[a:b] > 1
        if keep.any():
            out.append(_rows(1, kind=[1], bucket=[key[0].as_py()], block=[rows.column("block")[i].as_py()], a=[rising(t[i][keep])], b=[planes(doc[i][keep])], c=[planes(df[a:b][keep])]))
    return pa.concat_tables([rest.cast(pa.schema(_rows(0).schema)), pa.Table.from_batches(out, _rows(0).schema)])


def _prefixes(percent: int):
    def choose(key, table):
        t, doc, df = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        keys = sizes = common = None
        for kind, a, b, c in zip(table.column("kind").to_pylist(), *(table.column(x) for x in "abc"), strict=True):
            if kind == 2:
                keys, sizes, common = np.frombuffer(a.as_py(), U), unplaned(b.as_py()).astype(np.int64), np.frombuffer(c.as_py(), np.int64)
            else:
                t.append(risen(a.as_py())), doc.append(unplaned(b.as_py()).astype(np.int64)), df.append(unplaned(c.as_py()).astype(np.int64))
        t, doc, df = np.concatenate(t), np.concatenate(doc), np.concatenate(df)
        n = int(common[0])
        width, whole = common[1 + n : 1 + 2 * n], doc == _ALL  # common tokens stand in the same order on both sides
        at = np.argsort(t[whole])
        t, doc, df = np.concatenate([t[~whole], np.repeat(t[whole][at], width)]), np.concatenate([doc[~whole], common[1 + 2 * n :]]), np.concatenate([df[~whole], np.repeat(df[whole][at], width)])
        order = np.lexsort((t, df, doc))
        t, doc, df = t[order], doc[order], df[order]
        first = np.searchsorted(doc, np.arange(len(sizes) + 1))
        many = np.diff(first)
        out = [[], [], [], []]
        for i in np.flatnonzero(sizes - many < sizes - (percent * sizes + 99) // 100 + LEVELS):
            a, b = first[i], first[i + 1]
            e, take = level(int(sizes[i]), df[a:b], percent)
            if take:
                for column, x in zip(out, (t[a : a + take], np.full(take, keys[i] | U(e - 1)), np.full(take, sizes[i]), np.full(take, take)), strict=True):
                    column.append(x)
        return pa.table([as_long(np.concatenate(x)) if x else pa.nulls(0, pa.int64()) for x in out], ["token", "key", "size", "weight"])

    return choose


def _plain(c: str):
    return F.col(c).bitwiseAND(F.lit(~(LEVELS - 1)))


def class_links(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75) -> tuple[DataFrame, DataFrame, Scratch]:
    """(membership, links, tables): doc_id, n_shingles, key, h of every row; and (a, b) pairs of keys found similar,
    enough to connect every class of similar sets; tables holds both until it is dropped.

    Null and empty texts have no key and no link. Repeated rows are equal sets; other columns are ignored.
    h is Spark's xxhash64 of the text: with the id it finds a row's text again.
    """
    spark = lean(documents.sparkSession)
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("h"))
    tables = Scratch(spark)
    letters = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(1, letters // 6_000_000)  # about a million shingles each
    bits = min(52, max(24, letters.bit_length() + 5))

    def emit(batches):
        number = TaskContext.get().partitionId() << 24
        block = Block(number)
        for batch in batches:
            sizes, keys = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, U)
            for row, s in sets(batch.column("text"), k):
                if len(s):
                    sizes[row], keys[row] = len(s), signature(s)
                    block.add(int(keys[row]), s, bits)
                    if block.full(BLOCK):
                        yield from block.sent(bits, parts, COMMON)
                        number += 1
                        block = Block(number)
            h = batch.column("h").to_numpy()
            yield _rows(batch.num_rows, kind=np.zeros(batch.num_rows, np.int32), bucket=((h >> 8) % parts).astype(np.int32), doc_id=batch.column("doc_id"), n_shingles=sizes, key=pa.array(keys.view(np.int64), mask=sizes == 0), h=h)
        if block.total:
            yield from block.sent(bits, parts, COMMON)

    sent = docs.mapInArrow(emit, _SENT).repartition(parts, "bucket").groupBy("bucket").applyInArrow(_count, _SENT)
    counted = tables.write(sent, "counted")
    members = tables.write(counted.where("kind = 0").select("doc_id", "n_shingles", "key", "h"), "members")
    chosen = counted.where("kind > 0").groupBy("block").applyInArrow(_prefixes(percent), "token long, key long, size long, weight long")
    prefixes = chosen.repartition("token").distinct()  # dealt by token once, for the hubs and for the join
    by_weight = F.struct("weight", "key")
    hubs = prefixes.groupBy("token").agg(F.count("*").alias("width"), F.max_by(F.struct("key", "size"), by_weight).alias("hub")).where("width > 1")
    shared = tables.write(prefixes.join(hubs, "token").select("token", "key", "size", "weight", "width", F.col("hub.key").alias("hub"), F.col("hub.size").alias("hub_size")), "shared")
    tables.drop("counted")
    held = _held(docs, members, shared.select("key").distinct(), k, tables)

    alike = 100 * F.least("size", "hub_size") >= percent * F.greatest("size", "hub_size")
    links = tables.write(_linked(_stars(shared.where(alike), tables), held, percent, tables), "links")
    tables.drop("sent")
    rows = _classed(shared, links, tables)
    # second hubs: of the documents outside the first hub's class the one with the most shared tokens
    second = rows.where("class <> hub_class").groupBy("token").agg(F.max_by(F.struct("key", "size", "class"), by_weight).alias("x"))
    rows = rows.join(second, "token").where("class <> x.class").select("token", "key", "size", F.col("x.key").alias("hub"), F.col("x.size").alias("hub_size"))
    links = links.unionByName(tables.write(_linked(_stars(rows.where(alike), tables), held, percent, tables), "links"))
    tables.drop("sent", "apart")
    links = links.unionByName(tables.write(_linked(_cells(_classed(shared, links, tables), tables), held, percent, tables), "links"))
    tables.drop("sent", "apart", "placed", "shared", "held")
    return members, links.select(_plain("a").alias("a"), _plain("b").alias("b")), tables


def _classed(shared: DataFrame, links: DataFrame, tables: Scratch) -> DataFrame:
    """Rows of tokens whose documents are in different classes, with class and hub_class."""
    of = small(components(links, rounds=2), 16)  # documents with one label are connected; a few connected ones may still differ
    rows = shared.join(of.select(F.col("node").alias("key"), F.col("component").alias("class")), "key", "left").withColumn("class", F.coalesce("class", "key"))
    apart = tables.write(rows.groupBy("token").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("token"), "apart")
    rows = rows.join(small(apart, 8), "token", "left_semi")
    rows = rows.join(of.select(F.col("node").alias("hub"), F.col("component").alias("hub_class")), "hub", "left").withColumn("hub_class", F.coalesce("hub_class", "hub"))
    return tables.write(rows, "apart")


def _stars(rows: DataFrame, tables: Scratch) -> DataFrame:
    """Cells of a hub with documents that share a token with it, several for a hub of many."""
    pairs = tables.write(rows.where("key <> hub").select("key", "size", "hub", "hub_size").distinct(), "sent")
    parts = pairs.groupBy("hub").agg(F.ceil(F.sum("size") / CELL).alias("parts"))
    celled = pairs.join(parts, "hub").withColumn("cell", F.xxhash64("hub", F.pmod(F.xxhash64("key"), "parts")))
    none = F.array().cast("array<bigint>").alias("tokens")
    ends = celled.select("cell", "key", "size", F.lit(1).alias("side"), F.col("key").alias("class"), none)
    hubs = celled.select("cell", F.col("hub").alias("key"), F.col("hub_size").alias("size"), F.lit(0).alias("side"), F.col("hub").alias("class"), none)
    return tables.write(ends.unionByName(hubs.distinct()), "sent")


def _cells(rows: DataFrame, tables: Scratch) -> DataFrame:
    """Cells of the blocks of documents that share a token but not a class.

    A document belongs to the family of the hub of its most frequent token. A family's documents in the
    hub's own class and all others fall into separate blocks: two of the former never need to meet.
    """
    docs = rows.groupBy("key").agg(F.first("size").alias("size"), F.first("class").alias("class"), F.max_by(F.struct("hub", "hub_class"), F.struct("width", "hub")).alias("f"), F.collect_list("token").alias("tokens"))  # at most the prefix of a document
    docs = docs.select("key", "size", "class", "tokens", F.col("f.hub").alias("family"), (F.col("class") == F.col("f.hub_class")).alias("main"))
    docs = tables.write(docs, "placed")
    parts = docs.groupBy("family", "main").agg(F.ceil(F.sum("size") / CELL).alias("parts"))
    docs = docs.join(parts, ["family", "main"]).withColumn("block", F.xxhash64("family", "main", F.pmod(F.xxhash64("key"), "parts")))
    docs = tables.write(docs.select("key", "size", "class", "tokens", "block", F.when(F.col("main"), F.col("class")).alias("only")), "placed")
    at = tables.write(rows.select("token", "key").join(docs.select("key", "block", "only"), "key").select("token", "block", "only").distinct(), "placed")
    x, y = (at.select("token", F.col("block").alias(f"block_{c}"), F.col("only").alias(f"only_{c}")) for c in "xy")
    met = x.join(y, "token").where("block_x <= block_y and not coalesce(only_x = only_y, false)").select("block_x", "block_y").distinct()
    met = met.withColumn("cell", F.xxhash64("block_x", "block_y"))
    sides = met.select("cell", F.explode(F.when(F.col("block_x") == F.col("block_y"), F.array(F.struct(F.lit(2).alias("side"), F.col("block_x").alias("block")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("block_x").alias("block")), F.struct(F.lit(1).alias("side"), F.col("block_y").alias("block"))))).alias("s"))
    return tables.write(sides.select("cell", "s.side", "s.block").join(docs, "block").select("cell", "key", "size", "side", "class", "tokens"), "sent")


def _held(docs: DataFrame, members: DataFrame, keys: DataFrame, k: int, tables: Scratch) -> DataFrame:
    """(key, sketch, held): sketches and whole sets of the wanted keys, read from the text of one row of each."""
    anyone = F.coalesce("doc_id", F.lit(-(1 << 63)))
    wanted = keys.select(F.col("key").alias("full"), _plain("key").alias("key"))
    wanted = members.where("key is not null").join(wanted, "key").groupBy("full").agg(F.min(F.struct(anyone.alias("id"), "h")).alias("x")).select("full", "x.id", "x.h")

    def load(batches):
        for batch in batches:
            kept = [(sketch(s).tobytes(), s.tobytes()) for _, s in sets(batch.column("text"), k)]
            yield pa.RecordBatch.from_arrays([batch.column("full"), *(pa.array([x[i] for x in kept], pa.binary()) for i in (0, 1))], ["key", "sketch", "held"])

    wanted = tables.write(wanted, "wanted")
    found = docs.withColumn("id", anyone).join(small(wanted, 24), ["id", "h"]).select("full", "text").mapInArrow(load, "key long, sketch binary, held binary")
    held = tables.write(found, "held")
    if held.count() > wanted.count():  # repeated rows: one of each will do
        held = tables.write(held.groupBy("key").agg(F.first("sketch").alias("sketch"), F.first("held").alias("held")), "held")
    tables.drop("wanted")
    return held


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All places of the ranges of n places from start on, one after another."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def sketch(s: np.ndarray) -> np.ndarray:
    """Whether an odd number of hashes falls on each of a power of two of bits, two to four for each of the set.

    Bits that differ between two sketches each stand for at least one hash that only one of the sets holds. A sketch
    is halved by xor of neighbouring words: bits are dealt so that this gives the sketch of half the length.
    """
    wide = 1 << max(0, (2 * len(s) - 1).bit_length() - 6)  # words
    if not len(s):
        return np.zeros(1, U)
    x = mix(s + U(7))
    word = (x >> U(32)) & U(0xFFFFFFFF)
    odd = np.bincount((((word * U(wide)) >> U(32)) << U(6) | x & U(63)).astype(np.int64), minlength=64 * wide) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(U)


def possible(cell: pa.Table, percent: int) -> np.ndarray:
    """Of the documents of one cell those that shared tokens and sketches let be similar to another one there."""
    keys, size, side, classes = (cell.column(c).to_numpy() for c in ("key", "size", "side", "class"))
    demand, (names, met, first, n) = (keys & (LEVELS - 1)) + 1, _met(cell)
    sketches = [np.frombuffer(s.as_buffer(), U) for s in cell.column("sketch")]
    wide = np.array([len(x) for x in sketches], np.int64)
    place, rows = np.zeros((2, len(keys)), np.int64), {}  # sketches of one length, and those of twice the length halved
    for w in np.unique(np.append(wide, wide // 2)):
        own, double = np.flatnonzero(wide == w), np.flatnonzero(wide == 2 * w)
        if w:
            place[0, own], place[1, double] = np.arange(len(own)), len(own) + np.arange(len(double))
            rows[w] = np.array([sketches[i] for i in own] + [np.bitwise_xor.reduce(sketches[i].reshape(-1, 2), axis=1) for i in double], U).reshape(-1, w)
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    flag, found = np.zeros(len(names), np.int64), np.zeros(len(keys), bool)

    def near(x: int, y: np.ndarray) -> np.ndarray:
        if len(y) and n[x]:
            flag[met[first[x] : first[x] + n[x]]] = 1
            shared = np.add.reduceat(flag[met[_ranges(first[y], n[y])]], np.cumsum(n[y]) - n[y])
            y = y[shared >= np.minimum(demand[x], demand[y])]
            flag[met[first[x] : first[x] + n[x]]] = 0
        stay = np.ones(len(y), bool)
        for w in np.unique(np.minimum(wide[y], wide[x])):
            at = np.flatnonzero((np.minimum(wide[y], wide[x]) == w) & (np.maximum(wide[y], wide[x]) <= 2 * w))
            if not len(at):
                continue
            a, b = rows[w][place[int(wide[x] != w), x]], rows[w][place[(wide[y[at]] != w).astype(int), y[at]]]
            differ = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
            stay[at] = (100 + percent) * differ <= (100 - percent) * (size[x] + size[y[at]])
        return y[stay]

    for x in left:
        y = right[(classes[right] != classes[x]) & (100 * np.minimum(size[right], size[x]) >= percent * np.maximum(size[right], size[x]))]
        if side[x] == 2:
            y = y[keys[y] > keys[x]]
        new = near(x, y[~found[y]])
        if not found[x] and (len(new) or len(near(x, y[found[y]]))):
            found[x] = True
        found[new] = True
    return found


def _grouped(sent: DataFrame, held: DataFrame, to: str, schema: str, each_cell) -> DataFrame:
    """What each_cell makes of the cells, which come in groups of about four cells' shingles."""
    shingled, most = sent.agg(F.coalesce(F.sum("size"), F.lit(0)), 48 * F.count("*") + 8 * F.coalesce(F.sum(F.coalesce(F.size("tokens"), F.lit(0))), F.lit(0))).first()
    groups = max(1, math.ceil(shingled / (4 * CELL)))

    def compare(key, table):
        table = table.sort_by("cell")
        cells = table.column("cell").to_numpy()
        cuts = np.append(np.flatnonzero(np.append(True, cells[1:] != cells[:-1])), len(cells))
        return pa.concat_tables([each_cell(table.slice(a, b - a).combine_chunks()) for a, b in zip(cuts, cuts[1:], strict=False)])

    # sets are dealt once, by the group of their cell, where the list of documents can be broadcast; else only wanted sets are dealt by key
    held = held.select("key", to)
    listed = most <= BROADCAST_BYTES
    held = held if listed else held.join(small(sent.select("key").distinct(), 8), "key", "left_semi")
    whole = held.join(F.broadcast(sent) if listed else sent, "key").withColumn("group", F.pmod(F.xxhash64("cell"), F.lit(groups)).cast("int"))
    return whole.repartition(groups, "group").groupBy("group").applyInArrow(compare, schema)


def _linked(sent: DataFrame, held: DataFrame, percent: int, tables: Scratch) -> DataFrame:
    """(a, b): similar pairs of each cell, of a document of side 0 or 2 with one of side 1 or 2.

    sent: cell, key, size, side, class, tokens; documents without tokens are compared without counting shared ones.
    Documents that no sketch of their cell is near to stay behind before whole sets are sent.
    """
    columns = ["cell", "key", "size", "side", "class", "tokens"]
    types = dict(sent.dtypes)
    near = _grouped(sent, held, "sketch", ", ".join(f"{c} {types[c]}" for c in columns), lambda cell: cell.select(columns).filter(pa.array(possible(cell, percent))))
    near = tables.write(near, "sent")
    return _grouped(near, held, "held", "a long, b long", lambda cell: pa.table([as_long(x) for x in similar(cell, percent)], ["a", "b"])).distinct()


def _met(cell: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of a cell, the place of each document's tokens among them, and of each document the first and their number."""
    own = [np.asarray(t.values.to_numpy() if t.is_valid else (), np.int64) for t in cell.column("tokens")]
    n = np.array([len(t) for t in own])
    names, met = np.unique(np.concatenate(own), return_inverse=True)
    return names, met, np.cumsum(n) - n, n


def similar(cell: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of similar pairs of different classes in one cell: enough to connect all that are similar there, so that
    a cell gives fewer links than it has documents."""
    keys, size, side, classes = (cell.column(c).to_numpy() for c in ("key", "size", "side", "class"))
    demand, (names, met, first, n) = (keys & (LEVELS - 1)) + 1, _met(cell)
    words = [np.frombuffer(s.as_buffer(), U) for s in cell.column("held")]
    start = np.cumsum(size) - size
    every, places = np.unique(np.concatenate(words), return_inverse=True)
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    classes = classes.copy()  # grows together as links are found
    flag, mark, out = np.zeros(len(names), np.int64), np.zeros(len(every), np.int64), ([], [])
    for x in left:
        y = right[(classes[right] != classes[x]) & (100 * np.minimum(size[right], size[x]) >= percent * np.maximum(size[right], size[x]))]
        if side[x] == 2:
            y = y[keys[y] > keys[x]]
        if len(y) and n[x]:
            flag[met[first[x] : first[x] + n[x]]] = 1
            shared = np.add.reduceat(flag[met[_ranges(first[y], n[y])]], np.cumsum(n[y]) - n[y])
            y = y[shared >= np.minimum(demand[x], demand[y])]
            flag[met[first[x] : first[x] + n[x]]] = 0
        if len(y):
            mark[places[start[x] : start[x] + size[x]]] = 1
            both = np.add.reduceat(mark[places[_ranges(start[y], size[y])]], np.cumsum(size[y]) - size[y])
            mark[places[start[x] : start[x] + size[x]]] = 0
            y = y[100 * both >= percent * (size[x] + size[y] - both)]
            joined, at = np.unique(classes[y], return_index=True)
            out[0].append(np.full(len(joined), keys[x]))
            out[1].append(keys[y[at]])
            classes[np.isin(classes, joined)] = classes[x]
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in out)


def classes(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, h, key and class of every row: rows of one class are connected by links.

    Sets of texts that are null, empty or without words have size 0, no key and no class. h is the text's xxhash64.
    """
    members, links, tables = class_links(documents, doc_id, text, k, percent)
    of = components(links).withColumnRenamed("node", "key").withColumnRenamed("component", "class")
    joined = written(members.join(of, "key", "left").select("doc_id", "n_shingles", "h", "key", F.coalesce("class", "key").alias("class")), "jaccard-classes")
    tables.drop_all()
    return joined


def similar_classes(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable over links of Jaccard similarity >= percent/100.

    Texts that are null, empty or without words have size 0 and stand alone; repeated rows are kept as they
    are; a row without id takes part and has the smallest id of its class, null if there is none; an empty
    table gives no rows; further columns of the input are ignored.
    """
    joined = classes(documents, doc_id, text, k, percent)
    first = joined.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("component_id"))
    return joined.join(first, "class", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))

"""Ranked lexical search over bit-sliced Bloom signatures of documents, with exact scores for all that they cannot exclude.

The index holds blocks of documents of like size as bit matrices: a slice (row) for each bit of the signature, a column for
each document. A signature holds every term of its document, and again each term that occurs at least 2, 3, 5 or 9 times, so that a
query's slices give an upper bound of its score in every document of the block at once. The bounds' best documents are
scored exactly; whatever the k-th score of these does not exclude is then scored exactly, too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, Scratch, lean, written
from .text import U, flat, hashes, mix, slices, spans

BITS, PROBES = 8, 4  #: bits of a signature for each key of the largest document of its class; bits set by a key
LEVELS = (1, 2, 3, 5, 9)  #: a term is one key for each of these that its occurrences reach
BLOCK, WIDEST = 1 << 16, 256  #: bytes of a bit matrix, unless eight documents take more; documents of a block
TERMS = 1 << 15  #: terms of queries that are sent to the tasks at once
SHARE = 1 << 13  #: terms of queries whose slices are summed up at once
COUNTED = 1 << 20  #: terms that a task counts before it passes their counts on
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LONGS = pa.list_(pa.int64())
INDEX = pa.schema([("kind", pa.string()), ("term", pa.int64()), ("df", pa.int64()), ("docs", pa.int64()), ("terms", pa.int64()), ("doc", LONGS), ("row", LONGS), ("n", LONGS), ("most", LONGS), ("width", pa.int64()), ("bits", pa.binary())])
INDEX_DDL = "kind string, term long, df long, docs long, terms long, doc array<long>, row array<long>, n array<long>, most array<long>, width long, bits binary"


def occurrences(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, row of each distinct term from the first on, its hash, its occurrences), slice by slice, by row and hash."""
    data, offsets = flat(column)
    for a, b in slices(offsets):
        part, rows = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = spans(part, rows, _LETTER)
        term, row = hashes(part, starts, ends, True), np.repeat(np.arange(b - a), np.diff(first))
        order = np.lexsort((term, row))
        term, row = term[order], row[order]
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        yield a, b, row[at], term[at], np.diff(np.append(at, len(term)))


def probes(terms: np.ndarray, level: int, width: int) -> np.ndarray:
    """The bits of each term's key of one level."""
    key = mix(terms + U((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    a, b = key & U(0xFFFFFFFF), key >> U(32) | U(1)
    return ((a[:, None] + np.arange(PROBES, dtype=U) * b[:, None]) % U(width)).astype(np.int64)


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds for each unit of its weight; grows with its occurrences."""
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def table_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def signed(terms: np.ndarray) -> np.ndarray:
    return terms.astype(np.uint64).view(np.int64)


class Gathered:
    """Documents of one class of sizes until their block is full."""

    def __init__(self, width: int):
        self.width, self.full = width, min(WIDEST, max(8, BLOCK * 8 // width // 8 * 8))
        self.docs: list[tuple] = []
        self.at: list[np.ndarray] = []

    def add(self, doc: tuple, terms: np.ndarray, tf: np.ndarray) -> None:
        self.docs.append(doc)
        self.at.append(np.concatenate([probes(terms[tf >= least], i, self.width).ravel() for i, least in enumerate(LEVELS) if i == 0 or doc[3] >= least]))

    def block(self) -> pa.RecordBatch:
        matrix = np.zeros((self.width, -(-len(self.docs) // 8) * 8), bool)
        for j, at in enumerate(self.at):
            matrix[at, j] = True
        doc, row, n, most = (list(x) for x in zip(*self.docs, strict=True))
        self.docs, self.at = [], []
        return table_batch(INDEX, kind=["block"], doc=[doc], row=[row], n=[n], most=[most], width=[self.width], bits=[np.packbits(matrix, axis=1).tobytes()])


def index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks, counts of documents by term, and totals of (doc, row, text)."""
    gathered: dict[int, Gathered] = {}
    terms, dfs, waiting, docs, total = [], [], 0, 0, 0

    def counts() -> pa.RecordBatch:
        seen, at = np.unique(np.concatenate(terms), return_inverse=True)
        sums = np.bincount(at, weights=np.concatenate(dfs)).astype(np.int64)
        return table_batch(INDEX, kind=["term"] * len(seen), term=signed(seen), df=sums)

    for b in batches:
        doc, row = b["doc"].to_pylist(), b["row"].to_numpy(zero_copy_only=False)
        for a, _, of, term, tf in occurrences(b["text"]):
            if not len(of):
                continue
            seen, df = np.unique(term, return_counts=True)
            terms.append(seen)
            dfs.append(df)
            waiting += len(seen)
            if waiting > COUNTED:
                yield counts()
                terms, dfs, waiting = [], [], 0
            begins = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            for x, y in zip(begins.tolist(), np.append(begins[1:], len(of)).tolist(), strict=True):
                own, n, most = tf[x:y], int(tf[x:y].sum()), int(tf[x:y].max())
                keys = sum(int((own >= least).sum()) for least in LEVELS)
                width = BITS << max(3, (keys - 1).bit_length())
                at = gathered.setdefault(width, Gathered(width))
                i = a + int(of[x])
                at.add((doc[i], int(row[i]), n, most), term[x:y], own)
                docs, total = docs + 1, total + n
                if len(at.docs) == at.full:
                    yield at.block()
    if waiting:
        yield counts()
    for at in gathered.values():
        if at.docs:
            yield at.block()
    if docs:
        yield table_batch(INDEX, kind=["total"], docs=[docs], terms=[total])


def query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, term) of (item, text), once a row."""
    schema = pa.schema([("item", pa.int64()), ("term", pa.int64())])
    for b in batches:
        items = b["item"].to_numpy()
        for a, _, of, term, _ in occurrences(b["text"]):
            yield table_batch(schema, item=items[a + of], term=signed(term))


class Queries:
    """Some queries: items, and for each its terms with their weights, in shares of at most SHARE terms."""

    def __init__(self, item: np.ndarray, term: np.ndarray, weight: np.ndarray, docs: int, terms: int):
        order = np.lexsort((term, item))
        item, self.term, self.weight = item[order], term[order].view(np.uint64), weight[order]
        self.items, first, place = np.unique(item, return_index=True, return_inverse=True)
        self.first, self.docs, self.terms = np.append(first, len(item)), docs, terms
        self.shares = []
        for a in range(0, len(item), SHARE):
            own, at = np.unique(self.term[a : a + SHARE], return_inverse=True)
            of = place[a : a + SHARE]
            begins = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            self.shares.append((own, at, self.weight[a : a + SHARE], of[begins], begins))

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """What a document's number of terms adds to each divisor."""
        return 100 - 50 + 50 * n * self.docs // self.terms

    def bounds(self, width: int, bits: bytes, n: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores in one block: a row an item, a column a document."""
        matrix, m = np.frombuffer(bits, np.uint8).reshape(width, -1), self.lengths(n)
        out = np.zeros((len(self.items), len(n)), np.int64)
        for own, at, weight, item, begins in self.shares:
            here, held = np.arange(len(own)), None  # terms that some document of the block may hold
            value = np.zeros((len(own), len(n)), np.int64)
            for level, least in enumerate(LEVELS):
                if least > most.max() or not len(here):
                    break
                bit = np.bitwise_and.reduce(matrix[probes(own[here], level, width)], axis=1)
                if held is not None:
                    bit &= held
                some = bit.any(axis=1)
                here, held = here[some], bit[some]
                upto = np.minimum(most, LEVELS[level + 1] - 1) if level + 1 < len(LEVELS) else most
                value[here] = np.where(np.unpackbits(held, axis=1, count=len(n)).view(bool), gain(upto, m), value[here])
            out[item] += np.add.reduceat(weight[:, None] * value[at], begins, axis=0)
        return out


def best_bounds(batches: Iterator[pa.RecordBatch], queries: Queries, k: int) -> Iterator[pa.RecordBatch]:
    """Of each item the k documents with the highest bounds among those of a task."""
    q = len(queries.items)
    bound, doc, row, named = np.zeros((q, 0), np.int64), np.zeros((q, 0), np.int64), np.zeros((q, 0), np.int64), np.zeros((q, 0), bool)
    for b in batches:
        for i in range(b.num_rows):
            own = unpacked(b, i)
            new = queries.bounds(own["width"], own["bits"], own["n"], own["most"])
            wide = lambda x, new=new: np.broadcast_to(x, new.shape)
            bound = np.concatenate([bound, new], axis=1)
            doc, row, named = (np.concatenate([x, wide(own[c])], axis=1) for x, c in ((doc, "doc"), (row, "row"), (named, "named")))
            if bound.shape[1] > k:
                top = np.argpartition(-bound, k - 1, axis=1)[:, :k]
                bound, doc, row, named = (np.take_along_axis(x, top, axis=1) for x in (bound, doc, row, named))
    i, j = np.nonzero(bound)
    if len(i):
        schema = pa.schema([("item", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("bound", pa.int64())])
        yield table_batch(schema, item=queries.items[i], doc=pa.array(doc[i, j], mask=~named[i, j]), row=row[i, j], bound=bound[i, j])


def unpacked(b: pa.RecordBatch, i: int) -> dict:
    """One block of an index batch."""
    doc = b["doc"][i].values
    longs = lambda c: b[c][i].values.to_numpy(zero_copy_only=False).astype(np.int64)
    return {"doc": doc.fill_null(0).to_numpy(zero_copy_only=False), "named": doc.is_valid().to_numpy(zero_copy_only=False), "row": longs("row"), "n": longs("n"), "most": longs("most"), "width": b["width"][i].as_py(), "bits": b["bits"][i].as_py()}


def not_excluded(batches: Iterator[pa.RecordBatch], queries: Queries, floors: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(doc, row, items): every document with the items for which its bound reaches the floor (and 1)."""
    schema = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("items", LONGS)])
    for b in batches:
        for i in range(b.num_rows):
            own = unpacked(b, i)
            doc, item = np.nonzero(queries.bounds(own["width"], own["bits"], own["n"], own["most"]).T >= np.maximum(floors, 1))
            item = queries.items[item]
            at = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else doc
            if len(at):
                lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(doc)), pa.int32()), pa.array(item, pa.int64()))
                yield table_batch(schema, doc=pa.array(own["doc"][doc[at]], mask=~own["named"][doc[at]]), row=own["row"][doc[at]], items=lists)


def exact(batches: Iterator[pa.RecordBatch], queries: Queries) -> Iterator[pa.RecordBatch]:
    """(item, doc, score) above 0 of (doc, text, items), from the whole texts."""
    schema = pa.schema([("item", pa.int64()), ("doc", pa.int64()), ("score", pa.int64())])
    known = np.unique(queries.term)
    code = np.searchsorted(known, queries.term)
    for b in batches:
        lists = b["items"]
        offsets = np.asarray(lists.offsets)
        wanted = np.searchsorted(queries.items, lists.flatten().to_numpy(zero_copy_only=False))
        for a, c, of, term, tf in occurrences(b["text"]):
            n = np.bincount(of, weights=tf, minlength=c - a).astype(np.int64)
            at = np.minimum(np.searchsorted(known, term), max(len(known) - 1, 0))
            hit = known[at] == term if len(known) else np.zeros(len(term), bool)
            key, tf = of[hit] * len(known) + at[hit], tf[hit].astype(np.int64)  # ascending: by row, then by hash
            first, last = offsets[a : c + 1][:-1], offsets[a : c + 1][1:]
            row = np.repeat(np.arange(c - a), last - first)
            item = wanted[offsets[a] - offsets[0] : offsets[c] - offsets[0]]
            for x in range(0, len(item), 4096):  # (document, item) pairs by the terms of the items
                r, q = row[x : x + 4096], item[x : x + 4096]
                size = queries.first[q + 1] - queries.first[q]
                pair = np.repeat(np.arange(len(q)), size)
                place = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size) + queries.first[q][pair]
                seek = r[pair] * len(known) + code[place]
                found = np.minimum(np.searchsorted(key, seek), max(len(key) - 1, 0))
                there = key[found] == seek if len(key) else np.zeros(len(seek), bool)
                pair, place, times = pair[there], place[there], tf[found[there]] if len(key) else tf
                score = np.zeros(len(q), np.int64)
                np.add.at(score, pair, queries.weight[place] * gain(times, queries.lengths(n)[r[pair]]))
                on = np.flatnonzero(score > 0)
                if len(on):
                    yield table_batch(schema, item=queries.items[q[on]], doc=b["doc"].take(pa.array(a + r[on])), score=score[on])


def build(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, Scratch]:
    """(index, the scratch tables that hold it) of all documents with terms; see `INDEX`."""
    held = Scratch(lean(documents.sparkSession))
    return held.write(located(documents, doc_id, text).mapInArrow(index_rows, INDEX_DDL), "signature-index"), held


def located(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, row, text); `row`, a hash of the text, tells rows of one id apart."""
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return documents.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(own).alias("row"), own.alias("text"))


def top_documents(documents: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", batch: int = TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents with the highest score above 0, ties by ascending id.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z in lower case, told apart by 64-bit hashes. A term
    weighs floor(1000 ln((2 N + 2) / (2 df + 1))) and gives a document weight * (10^9 tf div (1000 tf + 20 m)), where m is
    50 + 50 n N div L. Every row of `documents` is a document, repeated rows too; rows without id take part and come last
    in ties. Null, empty and term-less texts are no documents and, as items, find nothing. Rows of one item id are one item;
    items without id take no part. An empty table on either side gives no rows. Other columns are not looked at.

    Queries go to the tasks in batches of about `batch` terms, each of which reads the index twice; documents that stay
    are joined with their texts and scored. The index goes before this returns; the scores stay in the scratch folder.
    """
    spark = lean(documents.sparkSession)
    docs = located(documents, doc_id, text)
    index, held = build(documents, doc_id, text)
    try:
        asked = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("item"), F.col(item_text).cast("string").alias("text"))
        total = index.where("kind = 'total'").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
        df = index.where("kind = 'term'").groupBy("term").agg(F.sum("df").alias("df"))
        weight = F.floor(1000 * F.log((F.lit(2.0) * (total.docs or 0) + 2) / (2 * F.col("df") + 1))).cast("long")
        weights = held.write(asked.mapInArrow(query_terms, "item long, term long").distinct().join(df, "term").select("item", "term", weight.alias("weight")), "signature-queries")
        batches = -(-weights.count() // batch)
        parts = []
        for i in range(batches):
            own = weights.where(F.pmod(F.xxhash64("item"), F.lit(batches)) == i).toArrow()  # about `batch` rows
            if own.num_rows:
                queries = Queries(*(own[c].to_numpy() for c in ("item", "term", "weight")), total.docs, total.terms)
                parts.append(held.write(searched(index, docs, queries, k, held), "signature-parts"))
        ranked = None
        for part in parts:
            ranked = part if ranked is None else ranked.unionByName(part)
        if ranked is None:
            return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
        return written(ranked, "signature-results")
    finally:
        held.drop_all()


def searched(index: DataFrame, docs: DataFrame, queries: Queries, k: int, held: Scratch) -> DataFrame:
    """The best k documents of each of these queries."""
    blocks = index.where("kind = 'block'").select("doc", "row", "n", "most", "width", "bits")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), F.asc_nulls_last("doc"), "row"))
    seeds = blocks.mapInArrow(partial(best_bounds, queries=queries, k=k), "item long, doc long, row long, bound long").withColumn("place", place).where(F.col("place") <= k)
    seeds = held.write(seeds.groupBy("doc", "row").agg(F.collect_set("item").alias("items")), "signature-seeds")
    first = ranked(scored(docs, seeds, queries), k).where(F.col("rank") == k).select("item", "score").toArrow()  # at most a row a query
    floors = np.zeros(len(queries.items), np.int64)
    floors[np.searchsorted(queries.items, first["item"].to_numpy())] = first["score"].to_numpy()
    stay = held.write(blocks.mapInArrow(partial(not_excluded, queries=queries, floors=floors), "doc long, row long, items array<long>").dropDuplicates(["doc", "row"]), "signature-candidates")
    return ranked(scored(docs, stay, queries), k).select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


def scored(docs: DataFrame, chosen: DataFrame, queries: Queries) -> DataFrame:
    """(item, doc, score) of the chosen documents' items; equal rows all count."""
    names = chosen.select(F.col("doc").alias("of"), F.col("row").alias("hash"), "items")
    size = chosen.agg(F.count("*").alias("rows"), F.sum(F.size("items")).alias("items")).first()
    if 24 * size.rows + 8 * (size.items or 0) <= BROADCAST_BYTES:
        names = F.broadcast(names)
    return docs.join(names, F.col("doc").eqNullSafe(F.col("of")) & (F.col("row") == F.col("hash"))).select("doc", "text", "items").mapInArrow(partial(exact, queries=queries), "item long, doc long, score long")


def ranked(scores: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc")))
    return scores.withColumn("rank", place).where(F.col("rank") <= k)

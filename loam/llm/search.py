"""Top-k search of a query set against all vectors: an exact threshold algorithm and cross-polytope hashing.

Candidates are dealt into shards of a fixed size by a hash of their id and queries into blocks; every
block meets every shard in one join on the shard's number, and each meeting returns at most k rows per
query, which a ranking over the query merges. An index is built once per shard, in the task that holds it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD, QUERIES = 4096, 1024  #: rows of a shard and queries of a block


def blocks(df: DataFrame, group: str, width: int) -> DataFrame:
    """One row per group: ids and vectors (padded with zeros to `width`) as flat doubles."""

    def pack(key, table):
        ids = table.column("vec_id").to_numpy()
        x = np.zeros((len(ids), width))
        for row, v in enumerate(table.column("v").to_pylist()):
            x[row, : len(v)] = v
        order = np.argsort(ids)
        return pa.table({group: pa.array([key[0].as_py()], pa.int32()), "ids": pa.array([ids[order].tobytes()], pa.binary()), "x": pa.array([x[order].tobytes()], pa.binary())})

    return df.groupBy(group).applyInArrow(pack, f"{group} int, ids binary, x binary")


def search(vectors: DataFrame, v: Column, valid: Column, k: int, every: int, index: Callable, find: Callable, score: str, vec_id: str) -> DataFrame:
    """query_id, rank, vec_id, score. index(x) -> anything; find(index, x, ids, q, q_ids, k) -> [(rows, scores)] per query."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(valid, F.lit(False)))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))  # of rows with one id the smallest vector counts
    of = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.count_if(F.col("vec_id") % every == 0).alias("q")).first()
    width = max(1, of["width"] or 1)
    shards, parts = max(1, math.ceil(of["n"] / SHARD)), max(1, math.ceil(of["q"] / QUERIES))
    held = blocks(rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")), "shard", width)
    asked = blocks(rows.where(F.col("vec_id") % every == 0).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)).cast("int")), "part", width)
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.col("ids").alias("q_ids"), F.col("x").alias("q"))

    def meet(batches):
        last, x, ids, made = None, None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                if last != (shard := batch.column("shard")[i].as_py()):
                    last = shard
                    x, ids = np.frombuffer(batch.column("x")[i].as_buffer()).reshape(-1, width), np.frombuffer(batch.column("ids")[i].as_buffer(), np.int64)
                    made = index(x)
                q, q_ids = np.frombuffer(batch.column("q")[i].as_buffer()).reshape(-1, width), np.frombuffer(batch.column("q_ids")[i].as_buffer(), np.int64)
                found = find(made, x, ids, q, q_ids, k)
                n = [len(f[0]) for f in found]
                got = [np.concatenate([f[j] for f in found]) if found else np.zeros(0) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, n)), pa.array(ids[got[0].astype(np.int64)]), pa.array(got[1].astype(np.int64 if score == "long" else np.float64))], ["query_id", "vec_id", "score"])

    found = asked.join(held, "shard").select("shard", "ids", "x", "q_ids", "q").mapInArrow(meet, f"query_id long, vec_id long, score {score}")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def finite(v: str) -> Column:
    return F.col(v).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def leading(scores: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller row (rows stand in order of ids)."""
    if len(scores) > k:
        keep = scores >= np.partition(scores, -k)[-k]
        scores, rows = scores[keep], rows[keep]
    order = np.lexsort((rows, -scores))[:k]
    return rows[order], scores[order]


def sorted_lists(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every dimension the rows in descending order, and their values."""
    order = np.argsort(-x, axis=0, kind="stable").T.astype(np.int32)
    return np.ascontiguousarray(order), np.ascontiguousarray(np.take_along_axis(x, order.T, axis=0).T)


def threshold_top_k(lists, x, ids, q, q_ids, k):
    """Fagin's threshold algorithm: sorted access to all lists in growing steps, random access to what is new.

    No row beyond the reached depth can score above the sum of the lists' current values; the search
    ends when the k-th score is higher than that (at a tie a row with a smaller id could still come).
    """
    order, values = lists
    n, out = len(x), []
    for query, own in zip(q, q_ids, strict=True):
        dims = np.flatnonzero(query)
        up = query[dims] > 0
        seen = ids == own
        rows, scores, left, depth, step = [], [], n - int(seen.sum()), 0, 32
        kth = -np.inf
        while left and depth < n:
            to = min(n, depth + step)
            if len(dims):
                met = np.zeros(n, bool)
                met[order[dims[up], depth:to]] = True
                met[order[dims[~up], n - to : n - depth]] = True
                new = np.flatnonzero(met & ~seen)
                limit = float(query[dims[up]] @ values[dims[up], to - 1] + query[dims[~up]] @ values[dims[~up], n - to])
            else:  # every score is 0
                new, to, limit = np.flatnonzero(~seen), n, 0.0
            if len(new):
                seen[new] = True
                left -= len(new)
                rows.append(new)
                scores.append(x[new] @ query)
                best = np.concatenate(scores)
                kth = np.partition(best, -k)[-k] if len(best) >= k else -np.inf
            depth, step = to, step * 2
            if kth > limit:
                break
        out.append(leading(np.concatenate(scores), np.concatenate(rows), k) if rows else (np.zeros(0, np.int64), np.zeros(0)))
    return out


def exact_top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (long): each query's k largest inner products of floor(scale * x), ties to the smaller id.

    Queries are the rows whose id is divisible by `every`. Vectors that are null or hold null or
    non-finite components take no part; shorter vectors count as padded with zeros; of rows with one id
    the smallest vector counts; an empty table gives no rows. Scores are exact below 2^53.
    """
    v = F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    return search(vectors, v, finite(embedding), k, every, sorted_lists, threshold_top_k, "long", vec_id)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of every row, scaled to keep lengths."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        step *= 2
    return x.reshape(n, d) / math.sqrt(d)


class CrossPolytope:
    """Tables of rows by their nearest signed axis after a pseudo-rotation (three rounds of signs and Hadamard)."""

    def __init__(self, width: int, tables: int, probes: int, seed: int = 7):
        self.d, self.probes = 1 << max(1, (width - 1).bit_length()), probes
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, self.d))

    def rotated(self, x: np.ndarray, table: int) -> np.ndarray:
        x = np.pad(x, ((0, 0), (0, self.d - x.shape[1])))
        for s in self.signs[table]:
            x = hadamard(x * s)
        return x

    def build(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per table: the rows in order of their bucket, and where each bucket begins."""
        out = []
        for t in range(len(self.signs)):
            y = self.rotated(x, t)
            axis = np.abs(y).argmax(axis=1)
            bucket = 2 * axis + (y[np.arange(len(y)), axis] < 0)
            order = np.argsort(bucket, kind="stable")
            out.append((order, np.searchsorted(bucket[order], np.arange(2 * self.d + 1))))
        return out

    def candidates(self, held, q: np.ndarray, n: int, least: int) -> list[np.ndarray]:
        """Rows in the best probed buckets of all tables, per query; probing goes on until at least `least` rows are found.

        Buckets follow each other by the query's share on their signed axis, so that all of them are reached in the end.
        """
        hit = [np.zeros(n, bool) for _ in q]
        ways = []
        for t in range(len(held)):
            y = self.rotated(q, t)
            ways.append(np.argsort(-np.stack([y, -y], axis=2).reshape(len(y), -1), axis=1, kind="stable"))
        for i, mask in enumerate(hit):
            done, upto = 0, self.probes
            while done < 2 * self.d and (not done or mask.sum() < min(least, n)):
                for (order, cuts), way in zip(held, ways, strict=True):
                    for b in way[i, done:upto]:
                        mask[order[cuts[b] : cuts[b + 1]]] = True
                done, upto = upto, upto * 2
        return [np.flatnonzero(m) for m in hit]


def approximate_top_k(vectors: DataFrame, k: int = 20, every: int = 20, tables: int = 8, probes: int = 16, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (double): each query's k largest inner products among the rows found.

    Rows are hashed by direction. If their lengths differ by over a thousandth, each gets one more
    component that brings all to one length, so that the largest inner product is the nearest direction.
    Where the probed buckets of a shard hold k rows or fewer, the next nearest buckets are probed too, until
    they hold more or all are read. Queries are the rows whose id is divisible by `every`. Vectors that are null, zero or hold null or non-finite components
    take no part; shorter vectors count as padded with zeros; of rows with one id the smallest vector
    counts; an empty table gives no rows.
    """
    length = F.sqrt(F.aggregate(F.transform(embedding, lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x * x))
    valid = finite(embedding) & (length > 0)
    span = vectors.where(valid).agg(F.min(length).alias("lo"), F.max(length).alias("hi")).first()
    high = span["hi"] or 1.0
    even = (span["lo"] or high) >= 0.999 * high

    def directed(x: np.ndarray, query: bool) -> np.ndarray:
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        if even or query:
            return x / np.where(norm > 0, norm, 1) if even else np.pad(x / np.where(norm > 0, norm, 1), ((0, 0), (0, 1)))
        return np.hstack([x, np.sqrt(np.maximum(high * high - norm * norm, 0))]) / high

    def index(x):
        own = CrossPolytope(x.shape[1] + (not even), tables, probes)
        return own, own.build(directed(x, query=False))

    def find(made, x, ids, q, q_ids, k):
        own, held = made
        out = []
        for query, q_id, rows in zip(q, q_ids, own.candidates(held, directed(q, query=True), len(x), k + 1), strict=True):
            rows = rows[ids[rows] != q_id]
            out.append(leading((x[rows] * query).sum(axis=1), rows, k))
        return out

    v = F.transform(embedding, lambda x: x.cast("double"))
    return search(vectors, v, valid, k, every, index, find, "double", vec_id)

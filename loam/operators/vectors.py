"""Nearest vectors of whole query sets: exact by blocks, or by learned cells of which only some are read.

Vectors that are null, empty, of another length than most, zero, or hold a null or a value that is not finite take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

SENT = 32 << 20  #: bytes of query vectors that go to the tasks at once
DIGITS = 12  #: scores are compared to so many, so that equal vectors tie whatever block they are in
CELLS = 256  #: learned cells at most
SAMPLE = 20_000  #: vectors that cells are learned from at most
TRIED = 200  #: queries that the number of probes is tried on
ROWS = 50_000  #: vectors of a cell in one file
FOUND = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
DDL = "qid long, id long, score double"


def usable(vectors: DataFrame, id_: str = "id", v: str = "v") -> DataFrame:
    """(id, v): vectors that can be compared, as array<double>."""
    own = vectors.select(F.col(id_).cast("long").alias("id"), F.col(v).cast("array<double>").alias("v")).where("id is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return own.where(fine)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Unit rows of a list column whose lists all have this width."""
    v = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def rounds(queries: DataFrame, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, unit rows) of the queries, at most about SENT bytes at once."""
    parts = max(1, -(-queries.count() * width * 8 // SENT))
    for i in range(parts):
        own = queries.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == i).select("id", "v").toArrow().combine_chunks()
        if own.num_rows:
            yield own["id"].to_numpy(), np.concatenate([matrix(c, width) for c in own["v"].chunks])


class Best:
    """The k best rows of each query so far."""

    def __init__(self, qids: np.ndarray, k: int):
        self.qids, self.k = qids, k
        self.score, self.id = np.full((len(qids), 0), -np.inf), np.zeros((len(qids), 0), np.int64)

    def add(self, which: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores: a row for each of the queries `which`, a column for each id."""
        if self.score.shape[1] < self.k:
            pad = self.k - self.score.shape[1]
            self.score = np.concatenate([self.score, np.full((len(self.qids), pad), -np.inf)], axis=1)
            self.id = np.concatenate([self.id, np.zeros((len(self.qids), pad), np.int64)], axis=1)
        own = np.concatenate([self.score[which], np.round(scores, DIGITS)], axis=1)
        names = np.concatenate([self.id[which], np.broadcast_to(ids, scores.shape)], axis=1)
        if len(ids) > 4 * self.k:  # by score first, where no tie at the edge can be cut
            edge = -np.partition(-own, self.k - 1, axis=1)[:, self.k - 1]
            if ((own >= edge[:, None]).sum(axis=1) == self.k).all():
                top = np.argpartition(-own, self.k - 1, axis=1)[:, : self.k]
                self.score[which], self.id[which] = np.take_along_axis(own, top, 1), np.take_along_axis(names, top, 1)
                return
        top = np.lexsort((names, -own), axis=1)[:, : self.k]
        self.score[which], self.id[which] = np.take_along_axis(own, top, 1), np.take_along_axis(names, top, 1)

    def batch(self) -> Iterator[pa.RecordBatch]:
        i, j = np.nonzero(np.isfinite(self.score))
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(self.qids[i]), pa.array(self.id[i, j]), pa.array(self.score[i, j])], schema=FOUND)


def width_of(vectors: DataFrame) -> int:
    """The most frequent length; of equally frequent ones the smallest. 0: no vectors."""
    top = vectors.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    return top.width if top else 0


def top_ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("qid", "id", "score", "rank")


def exact_nearest(corpus: DataFrame, queries: DataFrame, k: int, itself: bool = True) -> DataFrame:
    """(qid, id, score, rank): the k nearest rows of `corpus` (id, v) of every query by cosine, ties by the smaller id.

    Queries go to the tasks in rounds of bounded size; a task multiplies them with its vectors block by block and keeps k
    of each. itself: whether a query finds the row of its own id.
    """
    own, asked = usable(corpus), usable(queries)
    width = width_of(own)
    own, asked = own.where(F.size("v") == width), asked.where(F.size("v") == width)
    parts = [own.mapInArrow(lambda batches, qids=qids, q=q: nearest_rows(batches, qids, q, k, width, itself), DDL) for qids, q in rounds(asked, width)]
    found = reduce(DataFrame.union, parts) if parts else corpus.sparkSession.createDataFrame([], DDL)
    return top_ranked(found, k)


def nearest_rows(batches: Iterator[pa.RecordBatch], qids: np.ndarray, q: np.ndarray, k: int, width: int, itself: bool) -> Iterator[pa.RecordBatch]:
    best = Best(qids, k)
    for b in batches:
        if not b.num_rows:
            continue
        ids, v = b["id"].to_numpy(), matrix(b["v"], width)
        for a in range(0, len(qids), 256):
            which = np.arange(a, min(a + 256, len(qids)))
            scores = q[which] @ v.T
            if not itself:
                scores[qids[which][:, None] == ids] = -np.inf
            best.add(which, ids, scores)
    yield from best.batch()


def similar_rows(corpus: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """(qid, id, score) of every other row whose cosine with the query is at least `least`."""
    own, asked = usable(corpus), usable(queries)
    width = width_of(own)

    def near(batches: Iterator[pa.RecordBatch], qids: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, v = b["id"].to_numpy(), matrix(b["v"], width)
            for a in range(0, len(qids), 256):
                scores = np.round(q[a : a + 256] @ v.T, DIGITS)
                i, j = np.nonzero((scores >= least) & (qids[a : a + 256, None] != ids))
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(qids[a + i]), pa.array(ids[j]), pa.array(scores[i, j])], schema=FOUND)

    own, asked = own.where(F.size("v") == width), asked.where(F.size("v") == width)
    parts = [own.mapInArrow(lambda batches, qids=qids, q=q: near(batches, qids, q), DDL) for qids, q in rounds(asked, width)]
    return reduce(DataFrame.union, parts) if parts else corpus.sparkSession.createDataFrame([], DDL)


class Cells:
    """Vectors written by learned cells: `path` holds them by cell, `centres` has a unit row for each cell."""

    def __init__(self, path: str, centres: np.ndarray, width: int, rows: int, probes: int):
        self.path, self.centres, self.width, self.rows, self.probes = path, centres, width, rows, probes


def learned(sample: np.ndarray, cells: int, rounds_of: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centres by spherical k-means of a bounded sample; an empty cell takes the row that fits its centre least."""
    draw = np.random.default_rng(seed)
    centres = sample[draw.choice(len(sample), cells, replace=False)].copy()
    for _ in range(rounds_of):
        near = sample @ centres.T
        at, fit = near.argmax(axis=1), near.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, sample)
        empty = np.flatnonzero(np.bincount(at, minlength=cells) == 0)
        sums[empty] = sample[np.argsort(fit, kind="stable")[: len(empty)]]
        size = np.sqrt(np.einsum("ij,ij->i", sums, sums))
        centres = np.where(size[:, None] > 0, sums / np.where(size > 0, size, 1)[:, None], centres)
    return centres


def probes_needed(sample: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """Cells to probe so that queries drawn from the sample find this share of their k nearest in it."""
    tried = sample[:: max(1, len(sample) // TRIED)][:TRIED]
    scores = tried @ sample.T
    scores[scores > 1 - 1e-9] = -np.inf  # itself and its copies, which are always in the first cell
    k = min(k, len(sample) - 1)
    if k < 1:
        return 1
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    cell = (sample @ centres.T).argmax(axis=1)[best]
    order = np.argsort(-(tried @ centres.T), axis=1)
    place = np.argsort(order, axis=1)
    needed = np.sort(np.take_along_axis(place, cell, 1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def write_cells(vectors: DataFrame, held: Scratch, k: int = 10, recall: float = 0.95, cells: int = CELLS, sample: int = SAMPLE) -> Cells | None:
    """Learns cells from at most `sample` vectors (the smallest id hashes) and writes every vector into its nearest cell.

    Fewer than 4 vectors a cell: fewer cells. Cells of many rows are several files. How many cells a query has to probe is
    found on queries of the sample, for the recall that is asked for. None: there are no vectors.
    """
    own = usable(vectors)
    width, rows = width_of(own), 0
    own = own.where(F.size("v") == width)
    drawn = own.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow().combine_chunks()
    if not drawn.num_rows:
        return None
    drawn = np.concatenate([matrix(c, width) for c in drawn["v"].chunks])
    centres = learned(drawn, max(1, min(cells, len(drawn) // 4)))

    def cell_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = (matrix(b["v"], width) @ centres.T).argmax(axis=1) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32))], names=["id", "v", "cell"])

    placed = held.write(own.mapInArrow(cell_of, "id long, v array<double>, cell int"), "placed")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"))  # a row for each cell
    rows = sizes.agg(F.sum("n")).first()[0]
    parts = sizes.select("cell", F.ceil(F.col("n") / ROWS).cast("int").alias("parts"))
    dealt = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    path = held.path("cells")
    dealt.repartition("cell", "part").drop("part", "parts").write.partitionBy("cell").parquet(path)
    held.drop(placed)
    return Cells(path, centres, width, rows, probes_needed(drawn, centres, k, recall))


def nearest_in_cells(spark, stored: Cells, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """(qid, id, score, rank): the k nearest other rows of every query among those of its `probes` nearest cells.

    Only cells that some query probes are read (a partition filter); scores are exact cosines.
    """
    asked = usable(queries).where(F.size("v") == stored.width)
    few = min(probes or stored.probes, len(stored.centres))
    parts = []
    for qids, q in rounds(asked, stored.width):
        near = np.argpartition(-(q @ stored.centres.T), few - 1, axis=1)[:, :few]
        by_cell = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
        table = spark.read.parquet(stored.path).where(F.col("cell").isin(list(by_cell)))
        parts.append(table.select("id", "v", "cell").mapInArrow(lambda batches, qids=qids, q=q, by_cell=by_cell: probed_rows(batches, qids, q, by_cell, k, stored.width), DDL))
    found = reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], DDL)
    return top_ranked(found, k)


def probed_rows(batches: Iterator[pa.RecordBatch], qids: np.ndarray, q: np.ndarray, by_cell: dict[int, np.ndarray], k: int, width: int) -> Iterator[pa.RecordBatch]:
    best = Best(qids, k)
    for b in batches:
        cells = b["cell"].to_numpy()
        for c in np.unique(cells).tolist():
            own = b.filter(pa.array(cells == c))
            ids, v = own["id"].to_numpy(), matrix(own["v"], width)
            for a in range(0, len(by_cell[c]), 256):
                which = by_cell[c][a : a + 256]
                scores = q[which] @ v.T
                scores[qids[which][:, None] == ids] = -np.inf
                best.add(which, ids, scores)
    yield from best.batch()

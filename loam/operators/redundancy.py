"""Groups of memories whose vectors say the same, led by the newest of each."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..sources.scratch import Scratch
from .vectors import matrix, usable, width_of

SLACK = 1e-3  #: cosines of half-precision unit vectors are off by less
MEMBERS = 1024  #: rows of a bucket aimed at
NAMED = 8  #: alike rows that the first search of a bucket names for a row
SETTLED = 1 << 18  #: rows, of pairs and classes still open, that are settled at once and not by rounds
PAIR = pa.schema([("u", pa.int64()), ("w", pa.int64()), ("age", pa.int64()), ("sure", pa.bool_()), ("cut", pa.bool_())])
BUCKET = "bucket long, age long, id long, open boolean, leads boolean, half binary"


def tables_needed(rows: int, least: float, miss: float) -> tuple[int, int]:
    """(bits, tables): so many sign bits that buckets of unlike vectors are small, so many tables that a pair at `least` meets in one."""
    bits = min(30, max(2, math.ceil(math.log2(max(rows, 1) / MEMBERS))) if rows > MEMBERS else 2)
    alike = (1 - math.acos(least) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-alike)))


def bucket_rows(batches: Iterator[pa.RecordBatch], planes: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """(bucket, age, id, open, leads, half) of (id, age, v, open, leads): each vector once for every table of planes, in half precision."""
    tables, bits, _ = planes.shape
    for b in batches:
        if not b.num_rows:
            continue
        v = matrix(b["v"], width)
        side = (v @ planes.reshape(-1, width).T > 0).reshape(len(v), tables, bits)
        keys = (side << np.arange(bits)).sum(axis=2).astype(np.int64)
        half = pa.array([x.tobytes() for x in v.astype(np.float16)], pa.binary())
        for t in range(tables):
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, t] | (t << 32)), b["age"], b["id"], b["open"], b["leads"], half], names=["bucket", "age", "id", "open", "leads", "half"])


def newest_alike(batches: Iterator[pa.RecordBatch], least: float, named: int) -> Iterator[pa.RecordBatch]:
    """(u, w, age, sure, cut) of buckets that come in order, newest first: for each open row the newest `named` before it that
    are surely alike, the last of them marked as the cut, and those up to there which may be. One surely alike that leads ends the
    list without a cut: whatever is older decides nothing."""
    held: list[pa.RecordBatch] = []
    last = None

    def found() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        ids, ages, wanted, leading = (rows[c].to_numpy() for c in ("id", "age", "open", "leads"))
        v = np.frombuffer(b"".join(rows["half"].to_pylist()), np.float16).reshape(len(ids), -1).astype(np.float32)
        for a in range(0, len(ids), 256):
            mine = a + np.flatnonzero(wanted[a : a + 256])
            need = np.full(len(mine), named)
            for c in range(0, min(a + 256, len(ids)), 4096):
                if not len(mine):
                    break
                scores = v[mine] @ v[c : min(c + 4096, a + 256)].T
                i, j = np.divmod(np.flatnonzero(scores.ravel() >= least - SLACK), scores.shape[1])  # few, by row: all that follows is about these
                newer = c + j < mine[i]
                i, j = i[newer], j[newer]
                sure = scores[i, j] >= least + SLACK
                ends = sure & leading[c + j]
                first = np.searchsorted(i, np.arange(len(mine)))
                upto = lambda of: (n := np.cumsum(of)) - np.concatenate(([0], n))[first][i]  # of one row, itself with them  # noqa: B023, E731
                count = upto(sure)
                named_too = (count - sure < need[i]) & (upto(ends) == ends)  # none before it leads
                if named_too.any():
                    x, y = i[named_too], c + j[named_too]
                    last = sure & (count == need[i]) & ~ends
                    yield pa.RecordBatch.from_arrays([pa.array(ids[mine[x]]), pa.array(ids[y]), pa.array(ages[y]), pa.array(sure[named_too]), pa.array(last[named_too])], schema=PAIR)
                need = need - np.bincount(i[sure], minlength=len(mine))
                more = (need > 0) & (np.bincount(i[ends], minlength=len(mine)) == 0)
                mine, need = mine[more], need[more]

    for b in batches:
        bucket = b["bucket"].to_numpy()
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), b.num_rows]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if x == y:
                continue
            if last is not None and last != bucket[x]:
                yield from found()
                held = []
            held.append(b.slice(x, y - x))
            last = bucket[x]
    if held:
        yield from found()


def searched(rows: DataFrame, vectors: DataFrame, least: float, held: Scratch, named: int) -> DataFrame:
    """(u, w, age, cut) of bucket rows: pairs alike, w newer; of a row with a cut those up to its newest cut, which are all there are."""
    ordered = rows.repartition("bucket").sortWithinPartitions("bucket", "age", "id")
    pairs = ordered.mapInArrow(lambda part: newest_alike(part, least, named), "u long, w long, age long, sure boolean, cut boolean")
    pairs = held.write(pairs.groupBy("u", "w", "age").agg(F.max("sure").alias("sure"), F.max("cut").alias("cut")), "met")
    both = pairs.where("not sure").select("u", "w", "age").join(vectors.select(F.col("id").alias("u"), F.col("v").alias("a")), "u").join(vectors.select(F.col("id").alias("w"), F.col("v").alias("b")), "w")
    alike = pairs.where("sure").select("u", "w", "age", "cut").union(both.where(cosine("a", "b") >= least - 1e-12).select("u", "w", "age", F.lit(False).alias("cut")))
    ends = pairs.where("cut").groupBy("u").agg(F.min(F.struct("age", "w")).alias("end"))
    kept = alike.select("u", "w", "age").join(ends, "u", "left").where(F.col("end").isNull() | (F.struct("age", "w") <= F.col("end")))
    out = held.write(kept.select("u", "w", "age", F.col("end").isNotNull().alias("cut")), "pairs")
    held.drop(pairs)
    return out


def settled(classes: pa.Table, pairs: pa.Table) -> tuple[pa.Table, pa.Table, pa.Table]:
    """All rounds at once: (id, leader) of the classes (id, age, cut) that pairs (u, w, age, leads) decide, (id, cut) of the others and their pairs that are left."""
    classes, pairs = classes.sort_by([("age", "ascending"), ("id", "ascending")]), pairs.sort_by([("u", "ascending"), ("age", "ascending"), ("w", "ascending")])
    u, w, leads = (pairs[c].to_numpy() for c in ("u", "w", "leads"))
    ids = classes["id"].to_numpy()
    first, end = (np.searchsorted(u, ids, side=x).tolist() for x in ("left", "right"))
    w, leads = w.tolist(), leads.tolist()
    leader: dict[int, int] = {}  # newest first, so that all that a class may join are known before it, or wait
    for i, cut, a, z in zip(ids.tolist(), classes["cut"].to_pylist(), first, end, strict=True):
        while a < z and not leads[a] and leader.get(w[a], w[a]) != w[a]:
            a += 1
        if a == z:
            if not cut:
                leader[i] = i
        elif leads[a] or w[a] in leader:
            leader[i] = w[a]
    leads_now = [x or leader.get(j) == j for x, j in zip(leads, w, strict=True)]
    kept = np.array([i not in leader and (x or j not in leader) for i, j, x in zip(u.tolist(), w, leads_now, strict=True)], bool)
    decided = pa.table({"id": pa.array(leader.keys(), pa.int64()), "leader": pa.array(leader.values(), pa.int64())})
    waiting = np.array([i not in leader for i in ids.tolist()], bool)
    left = pairs.set_column(pairs.schema.get_field_index("leads"), "leads", pa.array(leads_now, pa.bool_())).select(["u", "w", "age", "leads"])
    return decided, classes.select(["id", "cut"]).filter(pa.array(waiting)), left.filter(pa.array(kept))


def grouped_by_leader(memories: DataFrame, least: float = 0.95, miss: float = 1e-4, seed: int = 3) -> DataFrame:
    """(id, leader, similarity): the group of every memory (id, created_at, v) with a vector; a leader leads itself.

    Newest first (ties by the smaller id, no date last), a memory that is in no group yet leads one, and all older memories
    in none whose cosine with it is at least `least` join it. Vectors that cannot be compared take no part; of rows
    with one id the newest counts.

    Equal vectors are one class from the start, as the newest of them decides for all. Classes meet in buckets of sign bits once; a pair at
    `least` is missed with probability `miss` at most. A bucket names the newest NAMED classes alike of each class. Rounds over these pairs
    alone follow: a class whose newest one alike that is in no other's group leads joins it, without one it leads, else it waits. Once
    SETTLED rows or fewer are open, they are settled at once. Where all that are open wait, those whose list was cut are searched for again, in their
    buckets only, among those that are open or lead, up to the first that leads or to eight times as many as before. A bucket's vectors
    (2 bytes a value) are held by one task.
    """
    spark, held = memories.sparkSession, Scratch(memories.sparkSession)
    age = F.coalesce(-F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(2**62))
    own = usable(memories).join(memories.where("id is not null").groupBy(F.col("id").cast("long").alias("id")).agg(F.min(age).alias("age")), "id")
    own = own.groupBy("id", "age").agg(F.min("v").alias("v"))
    width = width_of(own)
    own = held.write(own.where(F.size("v") == width).withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(1), "v")}), "vectors")
    first = F.min(F.struct("age", "id", "v")).alias("x")
    classes = held.write(own.groupBy("h", "g").agg(first).select("h", "g", "x.age", "x.id", "x.v"), "classes")
    rows = classes.count()
    if not rows:
        return spark.createDataFrame([], "id long, leader long, similarity double")
    bits, tables = tables_needed(rows, least, miss)
    planes = np.random.default_rng(seed).normal(size=(tables, bits, width))
    vectors = classes.select("id", "age", "v")
    dealt = lambda some: some.mapInArrow(lambda part: bucket_rows(part, planes, width), BUCKET)
    of_search = lambda some, open_, leads: some.select("id", "age", "v", F.lit(open_).alias("open"), F.lit(leads).alias("leads") if isinstance(leads, bool) else leads)
    cut_of = lambda some, met: some.join(met.where("cut").select(F.col("u").alias("id"), "cut").distinct(), "id", "left").select("id", F.coalesce("cut", F.lit(False)).alias("cut"))
    named = NAMED
    pairs = searched(dealt(of_search(vectors, True, False)), vectors, least, held, named)
    open_, done = held.write(cut_of(classes.select("id"), pairs), "open"), None
    pairs = held.write(pairs.select("u", "w", "age", F.lit(False).alias("leads")), "left")
    while True:
        few = open_.count() + pairs.count() <= SETTLED
        if few:
            parts = settled(open_.join(classes.select("id", "age"), "id").select("id", "age", "cut").toArrow(), pairs.toArrow())
            decided, open_, pairs = (spark.createDataFrame(part) for part in parts)
            decided = held.write(decided, "joined")
        else:
            best = pairs.groupBy(F.col("u").alias("id")).agg(F.min(F.struct("age", "w", "leads")).alias("x"))
            seen = held.write(open_.join(best, "id", "left").select("id", "cut", "x.w", F.coalesce("x.leads", F.lit(False)).alias("leads")), "round")
            alone = F.col("w").isNull() & ~F.col("cut")
            decided = held.write(seen.where(alone | F.col("leads")).select("id", F.when(alone, F.col("id")).otherwise(F.col("w")).alias("leader")), "joined")
            open_ = seen.where(~alone & ~F.col("leads")).select("id", "cut")
            now = decided.select(F.col("id").alias("w"), (F.col("id") == F.col("leader")).alias("now"))
            left = pairs.join(open_.select(F.col("id").alias("u")), "u", "left_semi").join(now, "w", "left").where(F.coalesce("now", F.lit(True)))
            pairs = left.select("u", "w", "age", F.coalesce("now", "leads").alias("leads"))
        open_, pairs = held.write(open_, "open"), held.write(pairs, "left")
        done = decided if done is None else done.union(decided)
        if open_.isEmpty():
            break
        if few or decided.isEmpty():  # all that are open wait for some whose list was cut: these see further, and no further than to one that leads
            named *= 8
            short = open_.where("cut").select("id")
            status = held.write(done.where("id = leader").select("id", F.lit(True).alias("leads")).union(open_.select("id", F.lit(False))), "status")
            again = of_search(vectors.join(short, "id", "left_semi"), True, False)
            others = of_search(vectors.join(short, "id", "left_anti").join(status, "id"), False, F.col("leads"))
            touched = dealt(again).select("bucket").distinct()
            new = searched(dealt(again.union(others)).join(touched, "bucket", "left_semi"), vectors, least, held, named)
            found = new.join(status.withColumnRenamed("id", "w"), "w").select("u", "w", "age", "leads")
            left = pairs.join(short.withColumnRenamed("id", "u"), "u", "left_anti").select("u", "w", "age", "leads")
            open_, pairs = held.write(open_.where("not cut").union(cut_of(short, new)), "open"), held.write(left.union(found), "left")
    joined = done.where("id <> leader").join(vectors.select("id", F.col("v").alias("a")), "id").join(vectors.select(F.col("id").alias("leader"), F.col("v").alias("b")), "leader")
    done = joined.select("id", "leader", cosine("a", "b").alias("similarity")).union(done.where("id = leader").select("id", "leader", F.lit(1.0)))
    of_class = classes.select("h", "g", F.col("id").alias("class")).join(done.withColumnRenamed("id", "class"), "class")
    return own.select("id", "h", "g").join(of_class, ["h", "g"]).select("id", "leader", "similarity")


def redundant_groups(members: DataFrame) -> DataFrame:
    """(leader, members, similarity, action) of groups of two and more; similarity: the mean of the others' with the leader."""
    others = F.when(F.col("id") != F.col("leader"), F.col("similarity"))
    out = members.groupBy("leader").agg(F.count("*").alias("members"), F.avg(others).alias("similarity")).where("members > 1")
    return out.withColumn("action", F.when(F.col("members") > 2, "merge").otherwise("review"))

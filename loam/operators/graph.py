"""Entities and their graph: extraction, merging, traversal, analytics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from ..sources.tables import unrolled

ENTITY = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"
LARGE = 128  #: sets of more neighbours are compared by sketches that grow with them, and not by prefixes
WORDS = 4  #: words of 64 bits in the sketch of a smaller set
CELL = 1 << 19  #: bytes of sketches on one side of a cell, about
SKETCHED = {"level": pa.int32(), "a": pa.string(), "n": pa.int64(), "whole": pa.bool_(), "sketch": pa.binary()}


def cut(df: DataFrame) -> DataFrame:
    """df, written in the session's shared folder (a new one where none is set, as in tests) and read again; shuffle files behind it go."""
    return Scratch(df.sparkSession).write(df, "cut")


def mentions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct runs of capitalised words of each text, in order of first appearance."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(ENTITY), 0))
    out = unrolled(docs, key, items=found, place="ordinal", item="name")
    return out.select(key, "name", (F.col("ordinal") + 1).alias("ordinal"), kind("name").alias("type"), F.lit(0.7).alias("confidence"))


def kind(name: str) -> Column:
    return F.when(F.col(name).rlike(r"^[A-Z][a-z]+(\s+[A-Z][a-z]+)*$"), "PERSON").otherwise("ORGANIZATION")


def query_entities(text: str) -> Column:
    """Capitalised runs and quoted phrases."""
    return F.array_union(F.regexp_extract_all(text, F.lit(ENTITY), 0), F.regexp_extract_all(text, F.lit('"([^"]*)"'), 1))


def keywords(text: str, stop: tuple[str, ...], most: int = 5) -> Column:
    return F.slice(F.filter(F.split(F.lower(text), " "), lambda w: (F.length(w) > 2) & ~w.isin(*stop)), 1, most)


def numbers(text: str) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\$?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?[KMB]?"), 0)


def co_mentions(found: DataFrame, key: str) -> DataFrame:
    """An edge from every entity of a text to the next one."""
    after = F.lead("name").over(Window.partitionBy(key).orderBy("ordinal"))
    return found.select(key, F.col("name").alias("src"), after.alias("dst")).where("dst is not null")


def following(docs: DataFrame, text: str) -> DataFrame:
    """(src, dst) from every entity of a text to the next one, from the last one to null: `co_mentions` of its `mentions`, within the row of the text."""
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(ENTITY), 0))
    pairs = F.transform("e", lambda x, i: F.struct(x.alias("src"), F.get("e", i + 1).alias("dst")))
    return docs.select(names.alias("e")).select(F.explode(pairs).alias("x")).select("x.src", "x.dst")


def merged_entities(found: DataFrame, key: str) -> DataFrame:
    return found.groupBy("name", "type").agg(F.count("*").alias("source_count"), F.min(key).alias("first_seen"), F.max(key).alias("last_seen"))


def merged_edges(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One edge per pair of entities, of known ones if these are given; loops are left out."""
    out = edges.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("source_count"))
    for end in ("src", "dst") if known else ():
        out = out.join(known.select(F.col("name").alias(end)), end, "left_semi")
    return out.select("src", "dst", "source_count")


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b) for every edge in either direction, once."""
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("a").alias("name")).agg(F.count("*").alias("degree"))


def reached(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, name, depth): entities within `hops` undirected steps of each seed, without the seed."""
    step = cut(both_ways(edges))
    seen = seeds.select(F.col("name").alias("seed"), "name", F.lit(0).alias("depth"))
    front = seen
    for depth in range(1, hops + 1):
        front = front.join(step, front["name"] == step["a"]).select("seed", F.col("b").alias("name")).distinct().join(seen.select("seed", "name"), ["seed", "name"], "left_anti")
        front = cut(front.withColumn("depth", F.lit(depth)))
        seen = seen.union(front)
    return seen.where("depth > 0")


def components(edges: DataFrame) -> DataFrame:
    """(name, component): the smallest name reachable, by minima over neighbours with shortcuts."""
    step = cut(both_ways(edges))
    label = step.select(F.col("a").alias("name")).distinct().withColumn("component", F.col("name"))
    while True:
        near = step.join(label.withColumnRenamed("name", "b"), "b").groupBy(F.col("a").alias("name")).agg(F.min("component").alias("near"))
        new = label.join(near, "name").select("name", F.least("component", "near").alias("component"))
        short = new.select(F.col("name").alias("component"), F.col("component").alias("further"))
        new = cut(new.join(short, "component").select("name", F.col("further").alias("component")))
        moved = new.withColumnRenamed("component", "c").join(label, "name").where("c <> component").isEmpty()
        label = new
        if moved:
            return label


def pagerank(edges: DataFrame, rounds: int, damping: float = 0.85) -> DataFrame:
    """Ranks that sum to one; what nodes without outgoing edges hold is shared by all."""
    nodes = cut(both_ways(edges).select(F.col("a").alias("name")).distinct())
    n = nodes.count()
    out = cut(edges.join(edges.groupBy("src").agg(F.count("*").alias("degree")), "src").select("src", "dst", "degree"))
    rank = nodes.withColumn("rank", F.lit(1.0 / max(1, n)))
    for _ in range(rounds):
        given = rank.join(out, rank["name"] == out["src"]).groupBy("dst").agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        lost = 1.0 - (given.agg(F.sum("got").alias("s")).first()["s"] or 0.0)
        rank = cut(nodes.join(given, nodes["name"] == given["dst"], "left").select("name", (F.lit((1 - damping) / max(1, n)) + damping * (F.coalesce("got", F.lit(0.0)) + lost / max(1, n))).alias("rank")))
    return rank


def communities(edges: DataFrame, rounds: int) -> DataFrame:
    """Label propagation: the most frequent label of the neighbours, the smallest of equal ones."""
    step = cut(both_ways(edges))
    label = step.select(F.col("a").alias("name")).distinct().withColumn("label", F.col("name"))
    for _ in range(rounds):
        votes = step.join(label.withColumnRenamed("name", "b"), "b").groupBy("a", "label").agg(F.count("*").alias("n"))
        best = Window.partitionBy("a").orderBy(F.desc("n"), "label")
        label = cut(votes.withColumn("i", F.row_number().over(best)).where("i = 1").select(F.col("a").alias("name"), "label"))
    return label


def neighbour_sets(step: DataFrame) -> DataFrame:
    """(a, n, h, g): of every entity how many neighbours it has, and two sums of hashes that tell equal sets."""
    return step.groupBy("a").agg(F.count("*").alias("n"), F.sum(F.xxhash64("b").cast("decimal(38,0)")).alias("h"), F.bit_xor(F.xxhash64(F.lit(1), "b")).alias("g"))


def same_neighbours(edges: DataFrame) -> DataFrame:
    """(a, b, members_a, members_b, similarity): every entity b with just the neighbours of a, the smallest such; similarity is 1.

    These are the members of the classes that `neighbour_similarity` compares: what holds for a holds for each b.
    """
    sets = cut(neighbour_sets(both_ways(edges)))
    classes = sets.groupBy("n", "h", "g").agg(F.min("a").alias("a"), F.count("*").alias("members")).where("members > 1")
    both = classes.join(sets.withColumnRenamed("a", "b"), ["n", "h", "g"]).where("a <> b")
    return both.select("a", "b", F.col("members").alias("members_a"), F.col("members").alias("members_b"), F.lit(1.0).alias("similarity"))


def sketch(hashes: np.ndarray, level: int) -> bytes:
    """Parities of the hashes at each place, four places for each of 2^level hashes: bits that differ between two sets each stand for at least one hash of only one of them."""
    places = 1 << max(6, level + 2)
    odd = np.bincount((hashes & (places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def sketches(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """(level, a, n, whole, sketch) of (a, n, hashes): every set at its own level (whole) and at those of larger sets that it may be similar to."""
    for b in batches:
        out: list[tuple] = []
        for a, n, own in zip(b["a"].to_pylist(), b["n"].to_pylist(), b["hashes"], strict=True):
            hashes, first = own.values.to_numpy(zero_copy_only=False), n.bit_length() - 1
            out += [(k, a, n, k == first, sketch(hashes, k)) for k in range(first, int(n / least * (1 + 1e-9)).bit_length())]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), SKETCHED.values(), strict=True)], names=list(SKETCHED))


def near_sketches(larger: pa.Table, smaller: pa.Table, least: float) -> pa.Table:
    """(x, y, nx, ny) of a cell: y of the larger sets and x of those with no more neighbours, where the sketches let be similar."""
    rows = lambda t: np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint64).reshape(t.num_rows, -1)
    hits = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    if larger.num_rows and smaller.num_rows:
        smaller = smaller.sort_by("n")
        y, x, ny, nx = rows(larger), rows(smaller), larger["n"].to_numpy(), smaller["n"].to_numpy()
        for i, n in enumerate(ny):
            a, z = np.searchsorted(nx, least * n - 1e-9), np.searchsorted(nx, n, side="right")
            differ = np.bitwise_count(x[a:z] ^ y[i]).sum(axis=1, dtype=np.int64)
            hit = a + np.flatnonzero(differ <= (nx[a:z] + n) * (1 - 2 * least / (1 + least)) + 1e-6)
            hits.append((hit, np.full(len(hit), i)))
    j, i = (pa.array(np.concatenate(c)) for c in zip(*hits, strict=True))
    return pa.table({"x": smaller["a"].take(j), "y": larger["a"].take(i), "nx": smaller["n"].take(j), "ny": larger["n"].take(i)})


def near_large(own: DataFrame, least: float) -> DataFrame:
    """(x, y, nx, ny): pairs whose larger set y has over LARGE neighbours and whose sketches let be similar.

    The sets of a level, which is a doubling of the neighbours of y, are dealt to cells of two blocks with about CELL bytes of sketches each.
    """
    sets = own.where(F.col("n") >= least * LARGE).groupBy("a", "n").agg(F.collect_list(F.xxhash64("b")).alias("hashes"))
    made = cut(sets.mapInArrow(lambda part: sketches(part, least), "level int, a string, n long, whole boolean, sketch binary"))
    wanted = F.col("whole") & (F.col("n") > LARGE)
    blocks = lambda of: F.ceil(F.sum(F.when(of, F.length("sketch"))) / CELL).cast("int")
    size = F.broadcast(made.groupBy("level").agg(blocks(wanted).alias("rows"), blocks(F.lit(True)).alias("columns")).where("rows > 0"))  # a row for each level
    place = lambda most: F.pmod(F.xxhash64("a"), most).cast("int")
    every = lambda most: F.explode(F.sequence(F.lit(0), F.col(most) - 1))
    sent = [F.col(c).alias(c) for c in ("level", "a", "n", "sketch")]  # new columns of each side
    ys = made.where(wanted).join(size, "level").select(place(F.col("rows")).alias("i"), every("columns").alias("j"), *sent)
    xs = made.join(size, "level").select(every("rows").alias("i"), place(F.col("columns")).alias("j"), *sent)
    cells = ys.groupBy("level", "i", "j").cogroup(xs.groupBy("level", "i", "j"))
    return cells.applyInArrow(lambda larger, smaller: near_sketches(larger, smaller, least), "x string, y string, nx long, ny long").where("nx < ny or x < y")


def neighbour_similarity(edges: DataFrame, least: float) -> DataFrame:
    """Pairs of entities whose sets of neighbours have a Jaccard similarity of at least `least` (above 0).

    Entities with equal sets are one class under its smallest name, with its number of members (`same_neighbours`). Neighbours are
    ordered from the rarest on; of the smaller set of a pair the first n - 2 * least / (1 + least) * n + 1, of the
    larger one the first n - least * n + 1 must have one in common, so that hubs rarely bring sets together. Sketches rule out
    nearly all of these pairs where they meet. Pairs with a set of over LARGE neighbours, whose prefixes meet ever more others
    as the graph grows, come from sketches alone (`near_large`). Of pairs that are left, all neighbours are counted.
    """
    step = cut(both_ways(edges))
    sets = neighbour_sets(step)
    named = cut(sets.groupBy("n", "h", "g").agg(F.min("a").alias("a"), F.count("*").alias("members")).select("a", "n", "members"))
    own = step.join(named.select("a", "n"), "a")
    rare = own.groupBy("b").agg(F.count("*").alias("in_sets"))
    place = F.row_number().over(Window.partitionBy("a").orderBy("in_sets", "b"))
    slack = 1e-9  # of rounding: a prefix may be longer than it need be, but not shorter
    prefix = (F.col("n") <= LARGE) & (F.col("place") <= F.col("n") - F.ceil(least * F.col("n") - slack) + 1)
    own = own.join(rare, "b").withColumn("place", place).withColumn("h", F.xxhash64("b"))
    bit = F.expr("shiftleft(1L, cast(pmod(shiftright(h, 8), 64) as int))")
    words = {f"s{i}": F.when(prefix, F.bit_xor(F.when(F.pmod("h", F.lit(WORDS)) == i, bit).otherwise(F.lit(0))).over(Window.partitionBy("a"))) for i in range(WORDS)}
    own = cut(own.withColumns(words).select("a", "b", "n", "place", *words))
    met = lambda end: ["b", F.col("a").alias(end), F.col("n").alias(f"n{end}"), F.col("place").alias(f"p{end}"), *[F.col(w).alias(end + w) for w in words]]
    probe = own.where(prefix).select(*met("y"))
    index = own.where(prefix & (F.col("place") <= F.col("n") - F.ceil(2 * least / (1 + least) * F.col("n") - slack) + 1)).select(*met("x"))
    near = index.join(probe, "b").where(F.expr("x <> y and (nx < ny or nx = ny and x < y)") & (F.col("nx") >= least * F.col("ny") - slack))
    needed = least / (1 + least) * (F.col("nx") + F.col("ny")) - slack
    near = near.where(sum(F.bit_count(F.col(f"x{w}").bitwiseXOR(F.col(f"y{w}"))) for w in words) <= F.col("nx") + F.col("ny") - 2 * needed)
    near = near.where(1 + F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) + F.least("px", "py") - 1 >= needed)
    # up to the last neighbour that meets in the prefixes all common ones have met: only what stands behind it is unknown
    near = near.groupBy("x", "y", "nx", "ny").agg(F.count("*").alias("met"), F.max("px").alias("px"), F.max("py").alias("py"))
    near = near.where(F.col("met") + F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) >= needed)
    near = cut(near.unionByName(near_large(own, least).withColumns({c: F.lit(0) for c in ("met", "px", "py")})))
    known = near.where("px = nx or py = ny").select("x", "y", "nx", "ny", F.col("met").alias("common"))
    open_ = near.where("px < nx and py < ny")
    behind = own.select(F.col("a").alias("x"), "b", F.col("place").alias("at"))
    ahead = open_.join(behind, "x").where("at > px").select("x", "y", "nx", "ny", "met", "b").join(own.select(F.col("a").alias("y"), "b"), ["y", "b"]).groupBy("x", "y").agg(F.count("*").alias("more"))
    found = known.unionByName(open_.join(ahead, ["x", "y"], "left").select("x", "y", "nx", "ny", (F.col("met") + F.coalesce("more", F.lit(0))).alias("common")))
    union = F.expr("nx + ny - common")
    found = found.where(F.col("common") >= least * union).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.round(F.col("common") / union, 6).alias("similarity"))
    size = lambda c: named.select(F.col("a").alias(c), F.col("members").alias(f"members_{c}"))
    return found.join(size("a"), "a").join(size("b"), "b").select("a", "b", "members_a", "members_b", "similarity")


def statistics(edges: DataFrame) -> DataFrame:
    one = edges.agg(F.count("*").alias("edges")).crossJoin(degrees(edges).agg(F.count("*").alias("entities")))  # two one-row frames
    return one.select("entities", "edges", F.round(F.try_divide("edges", "entities"), 6).alias("edges_per_entity"))


def touching(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges with a seed at either end, once."""
    out = edges.join(seeds.select(F.col("name").alias("src")), "src", "left_semi").select(*edges.columns)
    rest = edges.join(seeds.select(F.col("name").alias("src")), "src", "left_anti").join(seeds.select(F.col("name").alias("dst")), "dst", "left_semi").select(*edges.columns)
    return out.unionByName(rest)


def mentioning(found: DataFrame, entities: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` texts of each entity."""
    ranked = found.join(entities.select("name"), "name", "left_semi").withColumn("i", F.row_number().over(Window.partitionBy("name").orderBy(key)))
    return ranked.where(F.col("i") <= most).select("name", key)


def episodes(docs: DataFrame, text: str, at: str, kind: str = "memory") -> DataFrame:
    return docs.withColumns({"body": F.substring(text, 1, 10000), "type": F.lit(kind), "valid_from": F.col(at), "valid_to": F.col(at) + F.expr("interval 8760 hours")})

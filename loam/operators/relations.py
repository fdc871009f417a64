"""Typed relationships with validity and confidence: filtered traversal, shortest paths, timelines, subgraphs.

edges: (src, dst, type, rel_id, valid_from, valid_to, confidence, created_at); nodes: (name, type, created_at).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

#: A node with more than this share of all steps is a hub, whose steps are dealt to several tasks; there are at most 1 / HUB.
HUB = 1 / 4096
SEEDS = 4096  #: seeds that are numbered by one task


#: A node with more steps than so many, and than this share of all, is wide: there are at most 1 / share.
WIDE, WIDE_SHARE = 1024, 1 / 65536
BITS = 1024  #: of the sketch of a pair's nodes


class Steps:
    """Steps (a, b, and what goes with them) by the node that they leave, for frontiers to be joined with; `steps` come from a stored table."""

    def __init__(self, held: Scratch, steps: DataFrame, hub: float = HUB, wide: int = WIDE):
        degree = held.write(steps.groupBy("a").agg(F.count("*").alias("degree")), "degree")
        total = degree.agg(F.sum("degree")).first()[0] or 0
        share = max(1, int(total * hub))
        self.hubs = degree.where(F.col("degree") > share).select("a", F.ceil(F.col("degree") / share).cast("int").alias("parts"))
        self.wide = degree.where(F.col("degree") > max(wide, int(total * WIDE_SHARE))).select("a")
        part = F.coalesce(F.pmod(F.xxhash64("b"), "parts"), F.lit(0)).cast("int")
        self.table = steps.join(F.broadcast(self.hubs), "a", "left").withColumn("part", part).drop("parts")

    def after(self, frontier: DataFrame, node: str = "node", table: DataFrame | None = None) -> DataFrame:
        """Every row of the frontier with each step from its node, or each of some of the table; a row at a hub goes to each of the hub's parts."""
        own = frontier.withColumnRenamed(node, "a").join(F.broadcast(self.hubs), "a", "left")
        dealt = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        return dealt.join(self.table if table is None else table, ["a", "part"]).drop("part")

    def between(self, ahead: DataFrame, back: DataFrame) -> DataFrame:
        """(pair, u, v, rel_id) of steps from a node u of `ahead` (pair, node) to a node v of `back`, of the same pair.

        Steps are taken from u, but those from a wide u to a v that is not from v, so that no wide node is followed to all of
        its neighbours; a sketch of the other end's nodes leaves most of the other steps out before they are shuffled.
        """
        is_wide = lambda end: F.broadcast(self.wide.select(F.col("a").alias(end), F.lit(True).alias(f"wide_{end}")))
        marked = self.table.join(is_wide("a"), "a", "left").join(is_wide("b"), "b", "left").withColumns({f"wide_{end}": F.coalesce(f"wide_{end}", F.lit(False)) for end in "ab"})
        parts = []
        for here, there, which, u, v in ((ahead, back, "not wide_a or wide_b", "a", "b"), (back, ahead, "wide_b and not wide_a", "b", "a")):
            bit = F.pmod(F.xxhash64("node"), F.lit(BITS))
            own = there.select("pair", F.floor(bit / 64).alias("no"), (bit % 64).cast("int").alias("bit")).withColumn("bits", F.expr("shiftleft(1L, bit)"))
            sketch = own.groupBy("pair").agg(F.array(*[F.coalesce(F.bit_or(F.when(F.col("no") == i, F.col("bits"))), F.lit(0).cast("long")) for i in range(BITS // 64)]).alias("sketch"))
            found = self.after(here.select("pair", "node").join(sketch, "pair"), table=marked.where(which))
            at = F.pmod(F.xxhash64("b"), F.lit(BITS))
            found = found.where(F.getbit(F.get("sketch", F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1)
            parts.append(found.select("pair", F.col(u).alias("u"), F.col(v).alias("v"), "rel_id"))
        near = parts[0].unionByName(parts[1])
        return near.join(ahead.select("pair", F.col("node").alias("u")), ["pair", "u"], "left_semi").join(back.select("pair", F.col("node").alias("v")), ["pair", "v"], "left_semi")


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b, rel_id): every edge from both of its ends; loops are left out."""
    own = edges.where("src <> dst")
    return own.select(F.col("src").alias("a"), F.col("dst").alias("b"), "rel_id").union(own.select("dst", "src", "rel_id"))


def shortest_paths(edges: DataFrame, pairs: DataFrame, most: int = 3, hub: float = HUB, wide: int = WIDE) -> DataFrame:
    """(src, dst, length, path) for every pair that is connected by at most `most` edges in either direction.

    path: rel_ids from src to dst; of the shortest paths the smallest array. A node and itself: length 0, no edges.
    Pairs that are not connected, or hold a null, give no row; repeated pairs give one.

    Levels grow from both ends in turn, so that one end's level is never deeper than half of the path; a node is kept once
    for each pair and end with its smallest path, nodes seen before are cut, and pairs that have met leave both levels. The last
    step makes no level: it is looked for between the two that are there.
    """
    held = Scratch(edges.sparkSession)
    steps = Steps(held, both_ways(held.write(edges.select("src", "dst", "rel_id").where("src <> dst"), "edges")), hub, wide)
    asked = held.write(pairs.where("src is not null and dst is not null").select("src", "dst").distinct().withColumn("pair", F.monotonically_increasing_id()), "pairs")
    none = F.array().cast("array<string>")
    found = [asked.where("src = dst").select("pair", F.lit(0).alias("length"), none.alias("path"))]
    own = asked.where("src <> dst")
    level = {end: held.write(own.select("pair", F.col(end).alias("node"), none.alias("path")), "level") for end in ("src", "dst")}
    seen = {end: [level[end].select("pair", "node")] for end in level}
    for length in range(1, most + 1):
        if length == most:
            last = steps.between(level["src"], level["dst"]).join(level["src"].select("pair", F.col("node").alias("u"), F.col("path").alias("p")), ["pair", "u"])
            last = last.join(level["dst"].select("pair", F.col("node").alias("v"), F.col("path").alias("q")), ["pair", "v"])
            met = last.groupBy("pair").agg(F.min(F.concat("p", F.array("rel_id"), "q")).alias("path"))
        else:
            end = "src" if length % 2 else "dst"
            further = F.concat("path", F.array("rel_id")) if end == "src" else F.concat(F.array("rel_id"), "path")
            new = steps.after(level[end]).select("pair", F.col("b").alias("node"), further.alias("path")).groupBy("pair", "node").agg(F.min("path").alias("path"))
            new = held.write(new.join(reduce(DataFrame.union, seen[end]), ["pair", "node"], "left_anti"), "level")
            seen[end].append(new.select("pair", "node"))
            level[end] = new
            ahead, back = level["src"].withColumnRenamed("path", "p"), level["dst"].withColumnRenamed("path", "q")
            met = ahead.join(back, ["pair", "node"]).groupBy("pair").agg(F.min(F.concat("p", "q")).alias("path"))
        met = held.write(met.select("pair", F.lit(length).alias("length"), "path"), "met")
        found.append(met)
        level = {k: v.join(met, "pair", "left_anti") for k, v in level.items()}
    return reduce(DataFrame.union, found).join(asked, "pair").select("src", "dst", "length", "path")


def traversed(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, depth: int, types: list[str] | None = None, node_types: list[str] | None = None, least: float | None = None, directed: bool = True, hub: float = HUB) -> DataFrame:
    """(seed, name, type, depth, confidence, path): what each seed reaches within `depth` steps, and itself at depth 0.

    Only edges of the given types with at least the given confidence, and only nodes of the given types, are passed; the
    seed itself need not be of these. An edge without confidence counts as certain. path: name, relation, name, ... of the
    first visit; of equally short ones the smallest. confidence: the lowest on it. Seeds that are no nodes give no row.
    """
    held = Scratch(edges.sparkSession)
    own = edges.where("src <> dst").withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))
    if types is not None:
        own = own.where(F.col("type").isin(types))
    if least is not None:
        own = own.where(F.col("confidence") >= least)
    passing = nodes if node_types is None else nodes.where(F.col("type").isin(node_types))
    out = own.select(F.col("src").alias("a"), F.col("dst").alias("b"), "type", "confidence")
    if not directed:
        out = out.union(own.select("dst", "src", "type", "confidence"))
    steps = Steps(held, held.write(out.join(passing.select(F.col("name").alias("b"), F.col("type").alias("kind")), "b"), "steps"), hub)
    start = nodes.join(seeds.select("name").distinct(), "name", "left_semi")
    level = held.write(start.select(F.col("name").alias("seed"), "name", "type", F.lit(0).alias("depth"), F.lit(1.0).alias("confidence"), F.array("name").alias("path")), "level")
    seen = level
    for d in range(1, depth + 1):
        front = level.select("seed", F.col("name").alias("node"), F.col("confidence").alias("so_far"), "path")
        new = steps.after(front).select("seed", F.col("b").alias("name"), F.struct(F.concat("path", F.array("type", "b")).alias("path"), F.least("so_far", "confidence").alias("confidence"), F.col("kind").alias("kind")).alias("x"))
        new = new.groupBy("seed", "name").agg(F.min("x").alias("x")).join(seen.select("seed", "name"), ["seed", "name"], "left_anti")
        level = held.write(new.select("seed", "name", F.col("x.kind").alias("type"), F.lit(d).alias("depth"), F.col("x.confidence").alias("confidence"), F.col("x.path").alias("path")), "level")
        seen = seen.union(level)
    return seen


def connected(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, depth: int, hub: float = HUB) -> DataFrame:
    """(name, connected) of every seed among the nodes: how many other nodes lie within `depth` steps of any edge (src, dst), either way.

    Only nodes (name) are passed. 64 seeds are the bits of one number, so that a node has one row for each 64 seeds that reach it, and a
    round takes each edge once for them, where a row for each seed and node would grow as their product.
    """
    held = Scratch(edges.sparkSession)
    known = nodes.select("name").distinct()
    ends = edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    ends = ends.union(ends.select("b", "a")).distinct()
    steps = Steps(held, held.write(ends.join(known.withColumnRenamed("name", "b"), "b", "left_semi").select("a", "b"), "steps"), hub)
    start = held.write(known.join(seeds.select("name").distinct(), "name", "left_semi"), "seeds")
    parts = start.count() // SEEDS + 1
    place = F.row_number().over(Window.partitionBy("part").orderBy("name")) - 1
    start = start.withColumn("part", F.pmod(F.xxhash64("name"), F.lit(parts))).withColumn("place", place)
    start = held.write(start.select("name", F.struct("part", F.expr("place div 64").alias("no")).alias("word"), (F.col("place") % 64).alias("bit")), "places")
    reach = start.select("name", "word", F.expr("shiftleft(1L, bit)").alias("bits"))
    for _ in range(depth):
        further = steps.after(reach, "name").select(F.col("b").alias("name"), "word", "bits").union(reach)
        reach = held.write(further.groupBy("name", "word").agg(F.bit_or("bits").alias("bits")), "reach")
    counts = reach.groupBy("word").agg(F.array(*[F.sum(F.getbit("bits", F.lit(i))) for i in range(64)]).alias("counts"))
    return start.join(counts, "word").select("name", (F.get("counts", F.col("bit")) - 1).alias("connected")).where("connected > 0")


def touching(edges: DataFrame, entities: DataFrame, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """(entity, and the columns of edges): edges that leave, enter or touch an entity; a loop counts once for its entity."""
    own = edges if types is None else edges.where(F.col("type").isin(types))
    asked = entities.select(F.col("name").alias("entity")).distinct()
    parts = []
    if direction in ("out", "both"):
        parts.append(own.join(asked, F.col("src") == F.col("entity")))
    if direction in ("in", "both"):
        parts.append((own.where("src <> dst") if parts else own).join(asked, F.col("dst") == F.col("entity")))
    return reduce(DataFrame.unionByName, parts).select("entity", *edges.columns)


def within(start: str | None, end: str | None, open_ends: bool) -> Column:
    """Whether validity lies in [start, end]; an end that is not given does not matter, one that a row lacks only if `open_ends`."""
    parts = [F.lit(True)]
    if start is not None:
        parts.append(F.coalesce(F.col("valid_from") >= F.lit(start).cast("timestamp"), F.lit(open_ends)))
    if end is not None:
        parts.append(F.coalesce(F.col("valid_to") <= F.lit(end).cast("timestamp"), F.lit(open_ends)))
    return reduce(Column.__and__, parts)


def timeline(edges: DataFrame, entities: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Edges of each entity whose validity lies within [start, end], missing ends being open, with `at`, when they began."""
    return touching(edges, entities).where(within(start, end, True)).withColumn("at", F.coalesce("valid_from", "created_at"))


def facts_of(facts: DataFrame, entities: DataFrame, start: str | None = None, end: str | None = None, types: list[str] | None = None) -> DataFrame:
    """Facts (entity, type, valid_from, valid_to, ...) of the entities in a window of time; a fact without a bound that is asked for is out."""
    own = facts if types is None else facts.where(F.col("type").isin(types))
    return own.where(within(start, end, False)).join(entities.select(F.col("name").alias("entity")).distinct(), "entity", "left_semi")


def created_between(edges: DataFrame, nodes: DataFrame, start: str, end: str, node_types: list[str] | None = None, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) created in [start, end] of the given types; edges only between nodes that are kept."""
    new = F.col("created_at").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    kept = nodes.where(new if node_types is None else new & F.col("type").isin(node_types))
    own = edges.where(new if types is None else new & F.col("type").isin(types))
    for end_of in ("src", "dst"):
        own = own.join(kept.select(F.col("name").alias(end_of)), end_of, "left_semi")
    return kept, own.select(*edges.columns)


def subgraph(edges: DataFrame, seeds: DataFrame, depth: int, hub: float = HUB) -> tuple[DataFrame, DataFrame]:
    """(name, depth) of the nodes within `depth` steps of any seed, in either direction, and the edges between them."""
    held = Scratch(edges.sparkSession)
    edges = held.write(edges, "edges")
    own = edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    steps = Steps(held, own.union(own.select("b", "a")), hub)
    level = held.write(seeds.select("name").where("name is not null").distinct().withColumn("depth", F.lit(0)), "level")
    seen = level
    for d in range(1, depth + 1):
        new = steps.after(level.select(F.col("name").alias("node"))).select(F.col("b").alias("name")).distinct().join(seen.select("name"), "name", "left_anti")
        level = held.write(new.withColumn("depth", F.lit(d)), "level")
        seen = seen.union(level)
    own = edges
    for end in ("src", "dst"):
        own = own.join(seen.select(F.col("name").alias(end)), end, "left_semi")
    return seen, own.select(*edges.columns)

"""A trie of conversations by shared first turns, from sorted matrices of turn ids.

Conversations are range-partitioned by their turns. In a block of consecutive ones, rows are sorted (lexsort) as a padded
matrix of turn ids; where columns differ from the row above, the differences, or-accumulated from the left, mark the rows at
which a node begins at each depth, and reduceat sums up each depth. Nodes on the path of a block's first or last row may go on in
the neighbouring blocks: these two rows carry what the block knows of them, and all such rows are recombined in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, lean, written

CELLS = 1 << 20  #: of a padded matrix; a block has at least four rows
SHARED_TURNS = 6  #: a rebuilt conversation takes fewer than so many turns of the first one of its hundred
MOST = np.iinfo(np.int64).max
EMPTY = hashlib.sha256(b"").hexdigest()
#: What a row knows of the node at each depth of its path, from no turns on; `least` is a minimum, the others are sums.
PARTS = ("least", "n", "below", "children", "leaves", "lens")


class Rows:
    """Paths with parts: `counts` turns each, flat turn ids (two words) and code points, flat parts (counts + 1 each)."""

    def __init__(self, counts: np.ndarray, ids: np.ndarray, chars: np.ndarray, parts: dict[str, np.ndarray]):
        self.counts, self.ids, self.chars, self.parts = counts, ids, chars, parts
        self.at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.counts)

    def cut(self, a: int, b: int) -> Rows:
        x, y = self.at[a], self.at[b]
        return Rows(self.counts[a:b], self.ids[x:y], self.chars[x:y], {k: v[x + a : y + b] for k, v in self.parts.items()})

    @staticmethod
    def concat(rows: list[Rows]) -> Rows:
        return Rows(*(np.concatenate([getattr(r, k) for r in rows]) for k in ("counts", "ids", "chars")), {k: np.concatenate([r.parts[k] for r in rows]) for k in PARTS})


def members(counts: np.ndarray, ids: np.ndarray, chars: np.ndarray, names: np.ndarray) -> Rows:
    """Conversations as rows: each is one member of every node of its path, and `below` are its code points from there on."""
    at = np.concatenate([[0], np.cumsum(counts)])
    total = np.concatenate([[0], np.cumsum(chars)])
    place = np.arange(at[-1] + len(counts)) - np.repeat(np.arange(len(counts)), counts + 1)  # turns before each part
    row = np.repeat(np.arange(len(counts)), counts + 1)
    from_here = np.maximum(place - 1, at[:-1][row])  # a node has the text of the turn that leads to it, the root none
    none = np.zeros(len(place), np.int64)
    return Rows(counts, ids, chars, {"least": names[row], "n": none + 1, "below": total[at[1:]][row] - total[from_here], "children": none, "leaves": none, "lens": none})


def ranked(ids: np.ndarray) -> np.ndarray:
    """The ids as small numbers from 1 in the same order."""
    order = np.lexsort((ids[:, 1], ids[:, 0]))
    new = np.ones(len(ids), np.int64)
    new[1:] = (ids[order[1:]] != ids[order[:-1]]).any(axis=1)
    out = np.empty(len(ids), np.int64)
    out[order] = np.cumsum(new)
    return out


class Block:
    """The nodes of some rows. Open are, unless this is all there is (`whole`), those on the first or last row's path."""

    def __init__(self, rows: Rows, whole: bool, names: np.ndarray | None = None):
        n, width = len(rows), int(rows.counts.max(initial=0))
        turn, part = np.arange(width) < rows.counts[:, None], np.arange(width + 1) <= rows.counts[:, None]
        matrix = np.zeros((n, width), np.int64)
        matrix[turn] = ranked(rows.ids)
        keys = [names if names is not None else np.arange(n), *matrix.T[::-1]]  # the last key is the first to count
        self.order = order = np.lexsort(keys)
        matrix, self.counts, on = matrix[order], rows.counts[order], part[order]
        parts = {}
        for k in PARTS:
            full = np.full((n, width + 1), MOST if k == "least" else 0, np.int64)
            full[part] = rows.parts[k]
            parts[k] = full[order]
        chars = np.zeros((n, width + 1), np.int64)
        chars[:, 1:][turn] = rows.chars
        chars = chars[order]
        self.new = new = np.ones((n, width + 1), bool)  # rows from which on the first d turns are others
        new[1:, 0] = False
        np.logical_or.accumulate(matrix[1:] != matrix[:-1], axis=1, out=new[1:, 1:])
        self.closed = closed = new & on
        self.edges = [np.flatnonzero(new[:, d]) for d in range(width + 1)]
        if not whole:
            closed[0] = False
            for d, b in enumerate(self.edges):
                closed[b[-1], d] = False
        self.values: list[dict[str, np.ndarray]] = [{} for _ in range(width + 1)]
        leaves, lens = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for d in range(width, -1, -1):
            b, v = self.edges[d], self.values[d]
            total = lambda x, b=b: np.add.reduceat(x, b, dtype=np.int64)
            v["least"] = np.minimum.reduceat(parts["least"][:, d], b)
            v["n"], v["below"] = total(parts["n"][:, d]), total(parts["below"][:, d])
            v["children"] = total(parts["children"][:, d]) + (total(closed[:, d + 1]) if d < width else 0)
            leaves[b] += (v["children"] == 0) & closed[b, d]
            lens += closed[:, d] * chars[:, d]
            v["leaves"], v["lens"] = total(parts["leaves"][:, d]) + total(leaves), total(parts["lens"][:, d]) + total(lens)
        self.rows, self.whole = rows, whole

    def nodes(self) -> dict[str, np.ndarray]:
        """Closed nodes: their first row, depth and values; parent is MOST where it is open, and then on path 0 (first row) or 1."""
        out: dict[str, list[np.ndarray]] = {k: [] for k in ("row", "depth", "parent", "side", "least", "n", "children", "leaves", "saved")}
        for d, (b, v) in enumerate(zip(self.edges, self.values, strict=True)):
            k = np.flatnonzero(self.closed[b, d])
            out["row"].append(b[k])
            out["depth"].append(np.full(len(k), d))
            if d:
                up = np.searchsorted(self.edges[d - 1], b[k], "right") - 1
                outside = np.zeros(len(k), bool) if self.whole else (up == 0) | (up == len(self.edges[d - 1]) - 1)
                out["parent"].append(np.where(outside, MOST, self.values[d - 1]["least"][up]))
                out["side"].append((up > 0).astype(np.int64))
            else:
                out["parent"].append(np.full(len(k), MOST))
                out["side"].append(np.full(len(k), -1))
            for name in ("least", "n", "children", "leaves"):
                out[name].append(v[name][k])
            out["saved"].append(v["below"][k] - v["lens"][k])
        return {k: np.concatenate(v) for k, v in out.items()}

    def sides(self) -> list[Rows]:
        """The first row and, if it is another one, the last row, with what is known of their open nodes."""
        out = []
        for side, r in ((0, 0), (1, len(self.counts) - 1)):
            d = int(self.counts[r])
            if side and len(self.edges[d]) == 1:
                break
            parts = {k: np.full(d + 1, MOST if k == "least" else 0, np.int64) for k in PARTS}
            for depth in range(d + 1):
                if side == 0 or len(self.edges[depth]) > 1:
                    for k in PARTS:
                        parts[k][depth] = self.values[depth][k][-side]
            own = self.order[r]
            x, y = self.rows.at[own], self.rows.at[own + 1]
            out.append(Rows(np.array([d]), self.rows.ids[x:y], self.rows.chars[x:y], parts))
        return out

    def least(self) -> tuple[np.ndarray, np.ndarray]:
        """Of every row in the order given, the smallest member of the node at each depth, and the side if that is open, else -1."""
        n = len(self.counts)
        least, side = np.empty((n, len(self.edges)), np.int64), np.full((n, len(self.edges)), -1)
        for d, (b, v) in enumerate(zip(self.edges, self.values, strict=True)):
            at = np.repeat(np.arange(len(b)), np.diff(np.append(b, n)))
            least[self.order, d] = v["least"][at]
            if not self.whole:
                side[self.order, d] = np.where(at == 0, 0, np.where(at == len(b) - 1, 1, -1))
        return least, side


def ranges(counts: np.ndarray, cells: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose padded matrix has at most `cells` cells, or of four rows."""
    a = 0
    while a < len(counts):
        b, widest = a, 0
        while b < len(counts):
            widest = max(widest, int(counts[b]) + 1)
            if b - a >= 4 and widest * (b + 1 - a) > cells:
                break
            b += 1
        yield a, b
        a = b


def combined(rows: Rows, cells: int) -> tuple[list[dict], list[np.ndarray]]:
    """(nodes of each block, with their parents; of every row the smallest member at each depth) of rows in sorted order."""
    cuts = list(ranges(rows.counts, cells))
    blocks = [Block(rows.cut(a, b), len(cuts) == 1) for a, b in cuts]
    nodes, sides = [], []
    for block, (a, _) in zip(blocks, cuts, strict=True):
        own = block.nodes()
        own["row"] = block.order[own["row"]] + a
        nodes.append(own)
        sides.append([] if block.whole else block.sides())
    least = []
    if len(cuts) > 1:
        above, known = combined(Rows.concat([s for two in sides for s in two]), cells)
        first = np.concatenate([[0], np.cumsum([len(two) for two in sides])])
        owner = [i for i, two in enumerate(sides) for _ in two]
        for i, own in enumerate(nodes):
            for j in np.flatnonzero((own["parent"] == MOST) & (own["depth"] > 0)):
                own["parent"][j] = known[first[i] + own["side"][j]][own["depth"][j] - 1]
        for own in above:  # their rows are those of the blocks' sides
            own["row"] = np.array([cuts[owner[r]][0] + blocks[owner[r]].order[0 if r == first[owner[r]] else -1] for r in own["row"]], np.int64)
        nodes += above
    for i, (block, (a, b)) in enumerate(zip(blocks, cuts, strict=True)):
        values, side = block.least()
        for r in range(b - a):
            own = values[r, : rows.counts[a + r] + 1].copy()
            for d in np.flatnonzero(side[r, : len(own)] >= 0):
                own[d] = known[first[i] + (side[r, d] if side[r, d] < len(sides[i]) else 0)][d]
            least.append(own)
    return nodes, least


LONGS = pa.list_(pa.int64())
FOUND = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("block", pa.int64()), ("side", pa.int64()), ("path", pa.binary())])
EDGE = pa.schema([("ids", pa.binary()), ("chars", LONGS), *[(k, LONGS) for k in PARTS]])
ENDS = pa.schema([("path", pa.binary()), ("first", pa.int64()), ("listed", pa.string())])
BLOCKS = pa.schema([("kind", pa.string()), *FOUND, *EDGE, *[f for f in ENDS if f.name != "path"]])
SQL = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary", LONGS: "array<long>"}


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {SQL[f.type]}" for f in schema)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def node_columns(own: dict[str, np.ndarray]) -> dict[str, object]:
    parent = pa.array(own["parent"], mask=own["parent"] == MOST)
    return {"conv_id": own["least"], "depth": own["depth"], "parent_conv_id": parent, "n_convs": own["n"], "n_children": own["children"], "n_leaves": own["leaves"], "saved_tokens": own["saved"]}


def words(column: pa.Array) -> np.ndarray:
    """Turn ids of a binary column, sixteen bytes each, as two big-endian words."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data if data is not None else b"", ">u8", count=(at[-1] - at[0]) // 8, offset=at[0]).reshape(-1, 2).astype(np.uint64)


def numbers(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def block_rows(block: int, rows: Rows, names: np.ndarray, paths: pa.Array) -> Iterator[pa.RecordBatch]:
    """Closed nodes, the two sides, and lists of the conversations that end at open nodes, of sorted conversations."""
    done = Block(rows, False, names)
    own, names = done.nodes(), names[done.order]
    begins = np.flatnonzero(done.new[:, -1])
    hashed, open_ends = {}, []
    for a, b in zip(begins.tolist(), np.append(begins[1:], len(names)).tolist(), strict=True):
        listed = ",".join(map(str, names[a:b].tolist()))
        if done.closed[a, done.counts[a]]:
            hashed[a, int(done.counts[a])] = hashlib.sha256(listed.encode()).hexdigest()
        else:
            open_ends.append((hashlib.md5(paths[int(done.order[a])].as_py()).digest(), int(names[a]), listed))
    if len(own["row"]):
        ends = [hashed.get(k, EMPTY) for k in zip(own["row"].tolist(), own["depth"].tolist(), strict=True)]
        n = len(ends)
        waiting = (own["parent"] == MOST) & (own["depth"] > 0)
        yield batch(BLOCKS, kind=["node"] * n, **node_columns(own), ends_sha256=ends, block=pa.array(np.full(n, block), mask=~waiting), side=own["side"])
    for side, row in enumerate(done.sides()):
        path = row.ids.astype(">u8").tobytes()
        yield batch(BLOCKS, kind=["side"], block=[block], side=[side], ids=[path], chars=[row.chars], **{k: [v] for k, v in row.parts.items()})
    if open_ends:
        yield batch(BLOCKS, kind=["ends"] * len(open_ends), **dict(zip(("path", "first", "listed"), map(list, zip(*open_ends, strict=True)), strict=True)))


def shard(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """The blocks of one range of conversations, which come in sorted order: (conv_id, ids, chars)."""
    block, held = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, []

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal block, held
        if not held:
            return
        all_of = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held = []
        counts = np.diff(numbers_offsets(all_of["chars"]))
        for a, b in ranges(counts, cells):
            part = all_of.slice(a, b - a)
            names = part["conv_id"].to_numpy()
            yield from block_rows(block, members(counts[a:b], words(part["ids"]), numbers(part["chars"]), names), names, part["ids"])
            block += 1

    size = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.num_rows + len(b["chars"].flatten())
            if size > cells // 2:
                yield from flush()
                size = 0
    yield from flush()


def numbers_offsets(column: pa.Array) -> np.ndarray:
    return np.asarray(column.offsets)


def recombine(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """All sides of all blocks: the nodes on their paths, and of each side the smallest members along its path."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    everything = pa.Table.from_batches(parts).combine_chunks().sort_by([("ids", "ascending"), ("block", "ascending"), ("side", "ascending")]).to_batches()[0]
    counts = np.diff(numbers_offsets(everything["chars"]))
    rows = Rows(counts, words(everything["ids"]), numbers(everything["chars"]), {k: numbers(everything[k]) for k in PARTS})
    found, least = combined(rows, cells)
    for own in found:
        if not len(own["row"]):
            continue
        paths = {}
        for r in np.unique(own["row"]).tolist():  # hashes of the paths to the nodes that begin in a row
            depths, state, path = set(own["depth"][own["row"] == r].tolist()), hashlib.md5(), everything["ids"][r].as_py()
            for d in range(max(depths) + 1):
                if d:
                    state.update(path[16 * d - 16 : 16 * d])
                if d in depths:
                    paths[r, d] = state.digest()
        yield batch(SIDES, **node_columns(own), path=[paths[k] for k in zip(own["row"].tolist(), own["depth"].tolist(), strict=True)])
    for a in range(0, len(counts), 1000):
        b = min(a + 1000, len(counts))
        yield batch(SIDES, block=everything["block"].slice(a, b - a), side=everything["side"].slice(a, b - a), least=least[a:b])


SIDES = pa.schema([*FOUND, ("least", LONGS)])


def hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, ends_sha256) from the parts of each path's list, which come in order: SHA-256 goes on from part to part."""
    path, state = None, None
    for b in batches:
        for p, listed in zip(b["path"].to_pylist(), b["listed"].to_pylist(), strict=True):
            if p != path:
                if state is not None:
                    yield batch(HASHED, path=[path], ends_sha256=[state.hexdigest()])
                path, state = p, hashlib.sha256(listed.encode())
            else:
                state.update(b"," + listed.encode())
    if state is not None:
        yield batch(HASHED, path=[path], ends_sha256=[state.hexdigest()])


HASHED = pa.schema([("path", pa.binary()), ("ends_sha256", pa.string())])


def rebuilt(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, ids, chars) of every conversation, its first turns taken from the first one of its hundred.

    A turn's id is the MD5 of its role and text. Turns of equal number are ordered by that id.
    """
    words_of = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    said = F.md5(F.concat(F.char_length(words_of[0]).cast("string"), F.lit(":"), *words_of))
    turns = conversations.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.struct(F.col(turn).alias("turn"), said.alias("id"), F.char_length(words_of[1]).cast("long").alias("chars")).alias("x"))
    own = turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: F.struct(x["id"].alias("id"), x["chars"].alias("chars"))).alias("turns"))
    firsts = own.where("conv_id % 100 = 0").select(F.col("conv_id").alias("of"), F.slice("turns", 1, SHARED_TURNS - 1).alias("head"))
    both = own.withColumn("of", F.expr("conv_id - conv_id % 100")).join(firsts, "of", "left").withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % SHARED_TURNS).cast("int"))
    head = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h")))
    seq = both.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))).alias("seq"))
    return seq.select("conv_id", F.unhex(F.array_join("seq.id", "")).alias("ids"), F.col("seq.chars").alias("chars"))


def prefix_trie(paths: DataFrame, cells: int = CELLS) -> DataFrame:
    """The nodes of the trie of (conv_id, ids, chars): a conversation's turn ids, 16 bytes each, and its turns' code points.

    Columns: conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, where conv_id and depth name a node. conv_ids are distinct and not null; `rebuilt` sees to
    that. No conversations: no nodes, not even a root. Conversations without turns end at the root. A conversation's turn
    ids (24 bytes a turn, no texts) are one row.

    Range partitions are dealt by turns and conv_id, so that a group of equal conversations, or of equal first turns, is
    spread; blocks have at most `cells` cells. What one task recombines are two rows a block.
    Ids that end at a node which spans blocks are hashed in order as they stream by, as SHA-256 has no other way.
    """
    spark, held = lean(paths.sparkSession), Scratch(paths.sparkSession)
    ordered = paths.select("conv_id", "ids", "chars").repartitionByRange("ids", "conv_id").sortWithinPartitions("ids", "conv_id")
    blocks = held.write(ordered.mapInArrow(lambda parts: shard(parts, cells), ddl(BLOCKS)), "trie-blocks")
    sides = blocks.where("kind = 'side'").select("block", "side", *[f.name for f in EDGE])
    recombined = written(sides.repartition(1).mapInArrow(lambda parts: recombine(parts, cells), ddl(SIDES)), "trie-sides")
    lists = blocks.where("kind = 'ends'").select("path", "first", "listed").repartition("path").sortWithinPartitions("path", "first")
    hashed = lists.select("path", "listed").mapInArrow(hash_lists, ddl(HASHED)).select("path", F.col("ends_sha256").alias("own_sha256"))
    outer = recombined.where("depth is not null").join(hashed, "path", "left").withColumn("ends_sha256", F.coalesce("own_sha256", F.lit(EMPTY)))
    known = recombined.where("least is not null").select("block", "side", F.col("least").alias("known"))
    inner = blocks.where("kind = 'node' and block is null")
    waiting = blocks.where("kind = 'node' and block is not null").join(known, ["block", "side"]).withColumn("parent_conv_id", F.get("known", (F.col("depth") - 1).cast("int")))
    names = [f.name for f in FOUND][:8]
    return outer.select(*names).unionByName(inner.select(*names)).unionByName(waiting.select(*names))


def conversation_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", cells: int = CELLS) -> DataFrame:
    """The trie of rebuilt conversations (see `rebuilt`, `prefix_trie`).

    Rows without conv_id belong to no conversation and take no part; null roles and texts are empty; rows without turn come
    first; repeated rows are turns of their own. Other columns of the table are not used, whatever their names.
    """
    return prefix_trie(rebuilt(conversations, conv_id, turn, role, text), cells)

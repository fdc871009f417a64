"""Byte-level BPE token counts of whole texts, and best-fit packing of their pieces by bin completion.

Packing needs only how many pieces have each length (at most `capacity` numbers, whatever the corpus
size), so the branch-and-bound runs on that histogram: it fills a bin around the largest remaining
piece, applies the filling as often as the counts allow, and keeps the best of several searches with a
best-fit solution as the first incumbent. Spark numbers the pieces of each length and deals them out.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter, defaultdict
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pieces import CACHE, Merger
from .shared import lean, written
from .text import U, flat, hashes, slices

END = 0  #: the id that ends every document
LETTER, NUMBER, SPACE, OTHER = range(4)


class ByteBPE(Merger):
    """Merge rules of a byte-level BPE tokenizer file (vocabulary and merges of tokenizers' JSON)."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        size = max(vocab.values()) + 1
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ids = np.array([[vocab[a], vocab[b], vocab[a + b]] for a, b in merges], np.int64)
        rank = np.full(size, -1, np.int32)
        rank[ids[:, 2]] = np.arange(len(ids))
        super().__init__(size, ids[:, 0], ids[:, 1], ids[:, 2], rank)
        # bytes are written as printable characters: most as themselves, the rest from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.byte = np.array([vocab[chars[b]] for b in range(256)], np.int32)
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.path = path
        self.kind = np.full(0x110000, OTHER, np.uint8)
        for plane in range(0, 0x110000, 1 << 12):
            every = "".join(map(chr, (c for c in range(plane, plane + (1 << 12)) if not 0xD800 <= c < 0xE000)))
            for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\p{White_Space}")):
                if found := regex.findall(pattern, every):
                    self.kind[[ord(c) for c in found]] = kind

    @cached_property
    def whole(self):
        """The library's own tokenizer, for texts that spell a special token."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)


@lru_cache(maxsize=2)
def tables(path: str) -> ByteBPE:
    """The tokenizer's tables, built once in each Python worker."""
    return ByteBPE(path)


def cuts(codes: np.ndarray, rows: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Starts (as character numbers) of the pre-tokens of all rows; rows: first character of each row, and the end.

    A pre-token is a run of letters, of numbers or of other marks with at most one space (U+0020)
    before it; a run of white space without its last character, or with it at the end of a row; a
    contraction ('s 't 're 've 'm 'll 'd) where a pre-token would start at its mark.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    k = kind[codes]
    top = np.zeros(n + 1, bool)
    top[rows] = True
    top = top[:n]
    run = top.copy()
    run[1:] |= k[1:] != k[:-1]
    blank = codes == 32
    after_blank = np.append(False, blank[:-1]) & ~top
    space = k == SPACE
    start = run & ~(after_blank & ~space)
    last = np.append(space[:-1] & ~space[1:] & ~top[1:], False)  # white space before something in the same row
    start |= last
    mark = np.flatnonzero((codes == 39) & run & ~after_blank)
    if len(mark):
        padded = np.append(codes, [0, 0])
        inside = np.append(top, [True, True])
        one, two = np.where(inside[mark + 1], 0, padded[mark + 1]), np.where(inside[mark + 1] | inside[np.minimum(mark + 2, n + 1)], 0, padded[mark + 2])
        single = np.isin(one, [115, 116, 109, 100])
        double = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        for hit, width in ((single, 2), (double, 3)):
            at = mark[hit]
            for i in range(1, width):
                start[at + i] = False
            end = at + width
            start[end[end < n]] = True
    return np.flatnonzero(start)


class Tokens:
    """Ids of the pre-tokens met so far, by hash."""

    def __init__(self, table: ByteBPE):
        self.table = table
        self.clear()

    def clear(self):
        self.known, self.place = np.zeros(0, U), np.zeros(0, np.int64)
        self.ids, self.first, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def texts(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, first id of each row and the end)."""
        head = (data & 0xC0) != 0x80
        codes = data if head.all() else np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        place_of = None if head.all() else np.flatnonzero(head)
        char_rows = rows if place_of is None else np.searchsorted(place_of, rows)
        starts = cuts(codes, char_rows, self.table.kind)
        starts = starts if place_of is None else place_of[starts]
        ends = np.append(starts[1:], len(data))
        if len(self.first) > CACHE:
            self.clear()
        distinct, first, inverse = np.unique(hashes(data, starts, ends, lower=False), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        hit = at < len(self.known)
        hit[hit] = self.known[at[hit]] == distinct[hit]
        place = np.empty(len(distinct), np.int64)
        place[hit] = self.place[at[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            place[new] = len(self.first) + np.arange(len(new))
            a, width = starts[first[new]], (ends - starts)[first[new]]
            word = np.repeat(np.arange(len(new)), width)
            raw = data[np.repeat(a - (np.cumsum(width) - width), width) + np.arange(width.sum())]
            sym, word = self.table.merge(self.table.byte[raw], word)
            count = np.bincount(word, minlength=len(new))
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.ids = np.concatenate([self.ids, sym.astype(np.uint32)])
            known, held = np.concatenate([self.known, distinct[new]]), np.concatenate([self.place, place[new]])
            order = np.argsort(known, kind="stable")
            self.known, self.place = known[order], held[order]
        place = place[inverse]
        width = self.count[place]
        total = np.append(0, np.cumsum(width))
        ids = self.ids[np.repeat(self.first[place] - total[:-1], width) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, rows)]


def pieces(documents: DataFrame, tokenizer: str, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece of each document: doc_id, piece, start, length, ids_crc32.

    A document is its ids and then END; a longer one than `capacity` is cut so that only its first
    piece is shorter. Null counts as the empty text, which is END alone; repeated rows give repeated pieces.
    """
    lean(documents.sparkSession)
    source = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("__text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        table = tables(tokenizer)
        tokens = Tokens(table)
        for batch in batches:
            data, offsets = flat(batch.column("__text"))
            for a, b in slices(offsets):
                part, rows = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                raw = part.tobytes()
                ids, first = tokens.texts(part, rows) if len(part) else (np.zeros(0, np.uint32), np.zeros(b - a + 1, np.int64))
                special = any(s in raw for s in table.special)
                out: list[list] = [[], [], [], [], []]
                for i in range(b - a):
                    own = ids[first[i] : first[i + 1]]
                    if special and any(s in raw[rows[i] : rows[i + 1]] for s in table.special):
                        own = np.array(table.whole.encode(raw[rows[i] : rows[i + 1]].decode(), add_special_tokens=False).ids, np.uint32)
                    own = np.append(own, np.uint32(END)).astype("<u4")
                    edge = [0, *range(len(own) % capacity or capacity, len(own) + 1, capacity)]
                    for p, (x, y) in enumerate(zip(edge, edge[1:], strict=False)):
                        for column, value in zip(out, (a + i, p, x, y - x, zlib.crc32(own[x:y])), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])], names)

    return source.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over counts: [(lengths of a bin and how often each, number of such bins)]."""
    open_: dict[int, list[tuple[dict[int, int], int]]] = defaultdict(list)
    for s in sorted(counts, reverse=True):
        left = counts[s]
        for room in sorted(r for r in open_ if r >= s):
            while left and open_[room]:
                held, n = open_[room].pop()
                most = room // s
                full, rest = divmod(min(left, n * most), most)
                left -= full * most + rest
                if full:
                    open_[room - most * s].append((held | {s: most}, full))
                if rest:
                    open_[room - rest * s].append((held | {s: rest}, 1))
                if n - full - bool(rest):
                    open_[room].append((held, n - full - bool(rest)))
        if left:
            most = capacity // s
            full, rest = divmod(left, most)
            if full:
                open_[capacity - most * s].append(({s: most}, full))
            if rest:
                open_[capacity - rest * s].append(({s: rest}, 1))
    return [x for group in open_.values() for x in group]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: by total length, or by pieces too long to share a bin."""
    best, total = 0, sum(s * n for s, n in counts.items())
    best = -(-total // capacity)
    for k in sorted({s for s in counts if 2 * s <= capacity} | {0}):
        big = sum(n for s, n in counts.items() if s > capacity - k)
        half = [(s, n) for s, n in counts.items() if 2 * s > capacity and s <= capacity - k]
        small = sum(s * n for s, n in counts.items() if s >= k and 2 * s <= capacity)
        room = sum((capacity - s) * n for s, n in half)
        best = max(best, big + sum(n for _, n in half) + max(0, -(-(small - room) // capacity)))
    return best


def reach(sizes: list[int], left: dict[int, int], room: int) -> list[int]:
    """Of every suffix of `sizes` the sums up to `room` that its pieces can make, as bits."""
    out, mask = [1] * (len(sizes) + 1), (1 << (room + 1)) - 1
    for i in range(len(sizes) - 1, -1, -1):
        bits, n, step = out[i + 1], min(left[sizes[i]], room // sizes[i]), 1
        while n:  # multiplicities by doubling
            step = min(step, n)
            bits |= bits << (step * sizes[i]) & mask
            n, step = n - step, step * 2
        out[i] = bits
    return out


def dominated(held: dict[int, int], slack: int, sizes: list[int], left: dict[int, int]) -> bool:
    """Whether a piece outside could take the place of some inside that it is as long as, or longer within the slack.

    Any packing with this filling then has one as good with the other, which leaves the smaller pieces for later.
    """
    some = many = 0  # sums of one or more pieces, of two or more
    for s, n in held.items():
        for _ in range(n):
            many |= some << s | many
            some |= some << s | 1 << s
    some |= 1
    for x in sizes:
        if left[x] > held.get(x, 0):
            low = max(0, x - slack)
            if many >> x & 1 or some >> low & ((1 << (x - low)) - 1):
                return True
    return False


def fillings(sizes: list[int], left: dict[int, int], room: int, waste: int):
    """(pieces and how often each, waste) of all undominated fillings of `room` within the waste, least waste first.

    Pieces are `sizes` (descending, `left` of each). Only sums that the rest can make are followed, so no path is in vain.
    """
    sums = reach(sizes, left, room)
    for over in range(min(waste, room) + 1):
        if not sums[0] >> (room - over) & 1:
            continue
        stack: list[tuple[int, int, dict[int, int]]] = [(0, room - over, {})]
        while stack:
            i, need, held = stack.pop()
            if not need:
                if not dominated(held, over, sizes, left):
                    yield held, over
                continue
            while i < len(sizes) and sizes[i] > need:
                i += 1
            if i == len(sizes):
                continue
            s = sizes[i]
            for n in range(min(left[s], need // s) + 1):
                if sums[i + 1] >> (need - n * s) & 1:
                    stack.append((i + 1, need - n * s, held | {s: n} if n else held))


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = 20_000) -> list[tuple[dict[int, int], int]]:
    """[(lengths of a bin and how often each, number of such bins)] by branch and bound, best fit being the first incumbent.

    Each node fills a bin around the largest piece left, by undominated fillings, least waste first: as many such
    bins at once as the pieces allow, then only one. A branch ends where its waste is more than one bin fewer
    than the incumbent leaves; the search ends at the lower bound, when no branch is left (the incumbent is then
    optimal), or after `nodes` bins, with the best packing so far. Counts, not pieces, are searched.
    """
    best = best_fit(counts, capacity)
    bins, bound = sum(n for _, n in best), lower_bound(counts, capacity)
    total, left = sum(s * n for s, n in counts.items()), Counter(counts)
    path: list[tuple[dict[int, int], int, int]] = []  # bins, how many, their waste
    branches, lost, used = [], 0, 0

    def options():
        sizes = sorted((s for s, n in left.items() if n), reverse=True)
        s = sizes[0]
        left[s] -= 1
        around = [x for x in sizes if left[x] and x <= capacity - s]
        spare = (bins - 1) * capacity - total - lost
        found = fillings(around, dict(left), capacity - s, spare)
        left[s] += 1
        for held, over in found:
            whole = Counter(held)
            whole[s] += 1
            most = min(left[x] // n for x, n in whole.items())
            if over:
                most = min(most, max(1, spare // over))
            for times in (most, 1) if most > 1 else (1,):
                yield dict(whole), times, over * times

    if bins > bound:
        branches.append(options())
    while branches and nodes:
        nodes -= 1
        move = next(branches[-1], None)
        if move is None:
            branches.pop()
            if path:  # the bin that led here is taken back
                held, times, over = path.pop()
                lost, used = lost - over, used - times
                for x, n in held.items():
                    left[x] += n * times
            continue
        held, times, over = move
        if lost + over > (bins - 1) * capacity - total:
            continue
        path.append(move)
        lost, used = lost + over, used + times
        for x, n in held.items():
            left[x] -= n * times
        if any(left.values()):
            branches.append(options())
            continue
        if used < bins:
            best, bins = [(h, t) for h, t, _ in path], used
            if bins <= bound:
                break
        branches.append(iter(()))
    return best


def pack(parts: DataFrame, capacity: int = 2048, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """parts (with a column length) with sequence_id and offset: sequences of at most `capacity`, filled without gaps.

    Rows with equal keys may trade places with each other; an empty table gives no rows.
    """
    spark = parts.sparkSession
    parts = written(parts, "packing-pieces")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    salts = max(16, sum(counts.values()) // 100_000)
    salted = parts.withColumn("salt", F.pmod(F.xxhash64(*keys), F.lit(salts)))
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = before.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    numbered = salted.withColumn("i", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*keys)) - 1).join(before, ["length", "salt"])
    numbered = numbered.select(*parts.columns, (F.col("i") + F.col("before")).alias("i"))
    slots: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    filled, bins = Counter(), 0
    for held, times in bin_completion(counts, capacity):
        offset = 0
        for s, n in sorted(held.items(), reverse=True):
            slots[s].append((filled[s], bins, n, offset))
            filled[s] += n * times
            offset += n * s
        bins += times
    names = parts.columns
    plan = spark.sparkContext.broadcast({s: np.array(x, np.int64) for s, x in slots.items()})

    def deal(batches):
        for batch in batches:
            length, i = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "i"))
            sequence, offset = np.empty(len(i), np.int64), np.empty(len(i), np.int64)
            for s in np.unique(length):
                rows, x = np.flatnonzero(length == s), plan.value[int(s)]
                own = x[np.searchsorted(x[:, 0], i[rows], "right") - 1]
                at = i[rows] - own[:, 0]
                sequence[rows], offset[rows] = own[:, 1] + at // own[:, 2], own[:, 3] + at % own[:, 2] * s
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return numbered.mapInArrow(deal, f"{schema}, sequence_id long, offset long")

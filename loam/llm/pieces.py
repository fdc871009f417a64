"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts are cut where a space follows another character (no piece of the vocabulary has a space after
another character, so no merge crosses such a cut). Distinct words of a slice are merged together in
flat symbol arrays: each round finds the best pair of every word by a segmented minimum over pair
ranks, merges its leftmost occurrences at once, and compacts, until no pair of any word is left.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean
from .text import U, flat, hashes, slices

NONE = np.int32(2**31 - 1)
CACHE = 300_000  #: distinct words a task remembers before it starts afresh
SPACE = "▁"


class Merger:
    """Merge rules over symbols 0..size-1, applied to many words at once; higher symbols never merge.

    left, right, out: the rules; rank: of each symbol the rank of the rules that make it (lower merges first).
    """

    def __init__(self, size: int, left: np.ndarray, right: np.ndarray, out: np.ndarray, rank: np.ndarray):
        self.size, self.out, self.rank = size, out.astype(np.int32), np.append(rank, NONE).astype(np.int32)
        # merging into a symbol is safe everywhere at once if no rule that uses it comes earlier
        self.safe = np.ones(size + 1, bool)
        for part in (left, right):
            self.safe[part[rank[self.out] <= rank[part]]] = False
        self.key, self.bits = left.astype(np.int64) * size + right, 20
        while True:
            self.slot = np.full(1 << self.bits, -1, np.int32)
            at, rest, self.probes = self._at(self.key), np.arange(len(out)), 0
            while len(rest) and self.probes < 4:
                free = self.slot[at[rest]] < 0
                self.slot[at[rest[free]]] = rest[free]
                rest = rest[self.slot[at[rest]] != rest]
                at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
                self.probes += 1
            if not len(rest):
                break
            self.bits += 1

    def _at(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(U) * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece each pair merges to, or size where it doesn't."""
        key = left.astype(np.int64) * self.size + right
        known = (left < self.size) & (right < self.size)
        out, at, rest = np.full(len(key), self.size, np.int32), self._at(key), np.flatnonzero(known)
        for _ in range(self.probes):
            found = self.slot[at[rest]]
            hit = (found >= 0) & (self.key[found] == key[rest])
            out[rest[hit]] = self.out[found[hit]]
            rest = rest[~hit & (found >= 0)]
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
        return out

    def merge(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, word of each) after all merges."""
        done_sym, done_word = [], []
        if not len(sym):
            return sym, word
        to = np.full(len(sym), self.size, np.int32)
        to[:-1] = np.where(word[1:] == word[:-1], self.pairs(sym[:-1], sym[1:]), self.size)
        while len(sym):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            width = np.diff(np.append(starts, len(sym)))
            rank = self.rank[to]
            best = np.repeat(np.minimum.reduceat(rank, starts), width)
            over = best == NONE
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                sym, word, to, rank, best = (x[~over] for x in (sym, word, to, rank, best))
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == best)
            # of occurrences that overlap, every second one counts; unsafe pieces merge once per word and round
            run = np.append(True, (hit[1:] != hit[:-1] + 1) | (word[hit[1:]] != word[hit[:-1]]))
            first = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            head = np.append(True, word[hit[1:]] != word[hit[:-1]])
            one_by_one = ~self.safe[to[hit]]
            unsafe_word = np.maximum.reduceat(one_by_one, np.flatnonzero(head)) if one_by_one.any() else None
            take = (np.arange(len(hit)) - first) % 2 == 0
            if unsafe_word is not None:
                slow = np.repeat(unsafe_word, np.diff(np.append(np.flatnonzero(head), len(hit))))
                take = np.where(slow, head, take)
            hit = hit[take]
            sym[hit] = to[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            dirty = np.zeros(len(sym), bool)
            dirty[hit] = True
            sym, word, to, dirty = sym[keep], word[keep], to[keep], dirty[keep]
            dirty[:-1] |= dirty[1:]
            at = np.flatnonzero(dirty)
            inner = at[at + 1 < len(sym)]
            inner = inner[word[inner + 1] == word[inner]]
            to[at] = self.size
            to[inner] = self.pairs(sym[inner], sym[inner + 1])
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]


class Pieces(Merger):
    """Lookup tables of a model: characters to symbols, pairs of symbols to ranks, symbols to text."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        normal = {model.id_to_piece(i): i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        if any(SPACE in piece.lstrip(SPACE) for piece in normal):
            raise ValueError("the vocabulary has pieces with a space after another character")
        score = {p: model.get_score(i) for p, i in normal.items()}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        rank = np.full(size, NONE, np.int32)
        for p, i in normal.items():
            rank[i] = order[score[p]]
        left, right, out = [], [], []
        for p, i in normal.items():
            for cut in range(1, len(p)):
                if (a := normal.get(p[:cut])) is not None and (b := normal.get(p[cut:])) is not None:
                    left.append(a)
                    right.append(b)
                    out.append(i)
        super().__init__(size, np.array(left, np.int64), np.array(right, np.int64), np.array(out, np.int32), rank)
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.char[32] = self.char[ord(SPACE)]
        self.digits = [f"{i},".encode() for i in range(size)]
        self.plain = [model.id_to_piece(i).replace(SPACE, " ").encode() for i in range(size)]
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """The symbol of each code point; unknown ones become size + code point."""
        sym = self.char[codes]
        return np.where(sym < 0, self.size + codes, sym).astype(np.int32)

    def texts(self, symbols: list[int]) -> tuple[bytes, bytes, int]:
        """(ids joined and ended by commas, decoded bytes, number of ids)."""
        digits, plain = self.digits, self.plain
        if max(symbols) < self.size:
            return b"".join([digits[s] for s in symbols]), b"".join([plain[s] for s in symbols]), len(symbols)
        ids, back, n = [], [], 0
        for s in symbols:
            if s < self.size:
                ids.append(digits[s])
                back.append(plain[s])
                n += 1
            else:
                raw = chr(s - self.size).encode()
                ids += [digits[self.bytes[b]] for b in raw]
                back.append(raw)
                n += len(raw)
        return b"".join(ids), b"".join(back), n


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """The model's tables, built once in each Python worker."""
    return Pieces(path)


class Words:
    """Encodings of the words met so far, by word hash."""

    def __init__(self, table: Pieces):
        self.table = table
        self.clear()

    def clear(self):
        self.known, self.place = np.zeros(0, U), np.zeros(0, np.int64)
        self.ids, self.back, self.count = [], [], np.zeros(0, np.int64)

    def look(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of every word's encoding."""
        if len(self.ids) > CACHE:
            self.clear()
        h = hashes(data, starts, ends, lower=False)
        distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        hit = at < len(self.known)
        hit[hit] = self.known[at[hit]] == distinct[hit]
        place = np.empty(len(distinct), np.int64)
        place[hit] = self.place[at[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            place[new] = len(self.ids) + np.arange(len(new))
            self._encode(data, starts[first[new]], ends[first[new]])
            known, held = np.concatenate([self.known, distinct[new]]), np.concatenate([self.place, place[new]])
            order = np.argsort(known, kind="stable")
            self.known, self.place = known[order], held[order]
        return place[inverse]

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        width = ends - starts
        shift = np.cumsum(width) - width
        raw = data[np.repeat(starts - shift, width) + np.arange(width.sum())]
        head = (raw & 0xC0) != 0x80
        codes = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(starts)), width)[head]
        sym, word = self.table.merge(self.table.symbols(codes), word)
        cuts = np.searchsorted(word, np.arange(len(starts) + 1)).tolist()
        sym, counts = sym.tolist(), []
        for a, b in zip(cuts, cuts[1:], strict=False):
            ids, back, n = self.table.texts(sym[a:b])
            self.ids.append(ids)
            self.back.append(back)
            counts.append(n)
        self.count = np.concatenate([self.count, np.array(counts, np.int64)])


def spaced(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with a space before every text that isn't empty, word starts, word ends, first word of each row)."""
    lead = np.diff(rows) > 0
    at = rows[:-1] + np.cumsum(lead) - lead
    out = np.empty(len(data) + int(lead.sum()), np.uint8)
    own = np.ones(len(out), bool)
    own[at[lead]] = False
    out[own] = data
    out[~own] = 32
    rows = rows + np.append(0, np.cumsum(lead))
    cut = (out == 32) & np.append(True, out[:-1] != 32)
    cut[at[lead]] = True
    starts = np.flatnonzero(cut)
    return out, starts, np.append(starts[1:], len(out)), np.searchsorted(starts, rows)


def encode_decode(documents: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` with n_tokens long, ids string (decimal ids joined by commas) and decoded string (those ids decoded).

    Null and empty texts have no ids and decode to the empty text. Rows are kept one by one, repeated
    ones too; an empty table gives no rows; no other column is read, so clashing names do no harm.
    """
    lean(documents.sparkSession)
    source = documents.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("__text"))
    names = list(keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema) + ", n_tokens long, ids string, decoded string"

    def run(batches):
        words = Words(pieces(model))
        for batch in batches:
            data, offsets = flat(batch.column("__text"))
            for a, b in slices(offsets):
                part = data[offsets[a] : offsets[b]]
                rows = offsets[a : b + 1] - offsets[a]
                mark = np.flatnonzero((part[:-2] == 0xE2) & (part[1:-1] == 0x96) & (part[2:] == 0x81)) if len(part) > 2 else []
                if len(mark):  # the mark itself counts as a space
                    texts = [part[x:y].tobytes().replace(SPACE.encode(), b" ") for x, y in zip(rows, rows[1:], strict=False)]
                    part, rows = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
                part, starts, ends, first = spaced(part, rows)
                place = words.look(part, starts, ends)
                n = np.append(0, np.cumsum(words.count[place]))[first]
                place, first = place.tolist(), first.tolist()
                ids = [b"".join(map(words.ids.__getitem__, place[x:y]))[:-1] for x, y in zip(first, first[1:], strict=False)]
                back = [b"".join(map(words.back.__getitem__, place[x:y]))[1:] for x, y in zip(first, first[1:], strict=False)]
                own = [batch.column(c).slice(a, b - a) for c in names]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(n)), pa.array(ids, pa.binary()).cast(pa.string()), pa.array(back, pa.binary()).cast(pa.string())], [*names, "n_tokens", "ids", "decoded"])

    return source.mapInArrow(run, schema)

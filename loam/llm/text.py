"""Words and hashes of whole Arrow string columns, vectorised over flat byte buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE = 1 << 20  #: bytes of text handled at once; a longer text is a slice of its own
_ODD, _SEED = 0x9E3779B97F4A7C15, 0x5EED


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * U(_ODD) + U(_SEED))
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32
_BYTE_LOWER = _BYTE[_UPPER]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_WORD = ~_SPACE
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U), np.ones(1, U))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2^64 and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE + 1)
        _powers = tuple(np.concatenate([np.ones(1, U), np.cumprod(np.full(size - 1, base, U))]) for base in (_ODD, pow(_ODD, -1, 1 << 64)))
    return _powers[0][:n], _powers[1][:n]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each, or of one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = b


def spans(data: np.ndarray, rows: np.ndarray, letters: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of `data`, and of each row the index of its first word (one more at the end).

    A word is a run of the bytes that `letters` marks, by default those other than space and 0x09-0x0D; rows (offsets
    into data) end words.
    """
    word = letters[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = word[1:] != word[:-1]
    if len(data):
        edge[0] = edge[-1] = True
    edge[rows] = True
    cuts = np.flatnonzero(edge)
    keep = word[cuts[:-1]] if len(cuts) > 1 else np.zeros(0, bool)
    starts, ends = cuts[:-1][keep], cuts[1:][keep]
    return starts, ends, np.searchsorted(starts, rows)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each span's bytes; lower: A-Z count as a-z."""
    power, inverse = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * power[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U))


def ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of a sequence of hashes."""
    power, inverse = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * power[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U))


def each(column: pa.Array, lower: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, word starts, word ends, word hashes, first word of each row) slice by slice."""
    data, offsets = flat(column)
    for a, b in slices(offsets):
        part, rows = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = spans(part, rows)
        yield a, b, part, starts, ends, hashes(part, starts, ends, lower), first

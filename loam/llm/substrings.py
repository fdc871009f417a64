"""Removal of word windows that stand more than once in a corpus, by suffix automata of reference shards.

Every window of `length` words has one anchor: its smallest k-word hash, leftmost of equal ones. A
maximal run of windows with one anchor is a unit; equal windows have equal anchors, so only units under
one anchor can share windows. Equal units are counted together, and one met twice is repeated whole.
Anchors with different units are dealt into reference shards: a shard's distinct units form a
generalised suffix automaton whose states know how often their words occur, and streaming the units
through it gives matching statistics (the longest suffix that also occurs elsewhere); windows where they
reach `length` are repeated. An anchor with very many different units is counted window by window.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, lean
from .text import U, each, flat, mix, ranges

K = 6  #: words of an anchor
CROWD = 2000  #: different units from which on an anchor is counted window by window
SHARD_UNITS = 1500  #: units of a reference shard, about
_PLACE = 28  #: bits of a word's place in a comparison key
_WIDE = np.array([0x9E3779B97F4A7C15 * (2 * i + 5) % (1 << 64) for i in range(K)], U)


def units(words: np.ndarray, first: np.ndarray, length: int):
    """(anchor, unit, row, first window, windows) of all rows; words: hashes, first: first word of each row and the end."""
    n = len(words)
    starts = [np.arange(a, b - length + 1) for a, b in zip(first, first[1:], strict=False) if b - a >= length]
    if not starts:
        return (np.zeros(0, U), np.zeros(0, U), *(np.zeros(0, np.int64) for _ in range(3)))
    starts = np.concatenate(starts)
    grams = np.zeros(n - K + 1, U)
    for i in range(K):
        grams += words[i : n - K + 1 + i] * _WIDE[i]
    grams = mix(grams)
    low = U((1 << _PLACE) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=U)
    span, width = length - K + 1, 1
    while width * 2 <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    place = (least[starts] & low).astype(np.int64)
    row = np.searchsorted(first, starts, "right") - 1
    new = np.append(True, (place[1:] != place[:-1]) | (row[1:] != row[:-1]))
    head = np.flatnonzero(new)
    s, count = starts[head], np.diff(np.append(head, len(starts)))
    unit = mix(ranges(words, s, s + count + length - 1) + (place[head] - s).astype(U))
    return grams[place[head]], unit, row[head], s - first[row[head]], count


def automaton(sequences: list[list[int]], weights: list[int]) -> tuple[list[dict], list[int], list[int], list[int]]:
    """(transitions, suffix links, longest lengths, weighted occurrences) of the suffix automaton of all sequences."""
    nexts: list[dict] = [{}]
    link, longest, times = [-1], [0], [0]
    for words, weight in zip(sequences, weights, strict=True):
        last = 0
        for c in words:
            q = nexts[last].get(c)
            if q is not None and longest[q] == longest[last] + 1:
                last = q
                times[q] += weight
                continue
            if q is None:
                cur = len(nexts)
                nexts.append({})
                longest.append(longest[last] + 1)
                link.append(0)
                times.append(0)
                p = last
                while p != -1 and c not in nexts[p]:
                    nexts[p][c] = cur
                    p = link[p]
                if p == -1:
                    last = cur
                    times[cur] += weight
                    continue
                q = nexts[p][c]
                if longest[q] == longest[p] + 1:
                    link[cur] = q
                    last = cur
                    times[cur] += weight
                    continue
            else:
                cur, p = -1, last
            clone = len(nexts)
            nexts.append(nexts[q].copy())
            longest.append(longest[p] + 1)
            link.append(link[q])
            times.append(0)
            while p != -1 and nexts[p].get(c) == q:
                nexts[p][c] = clone
                p = link[p]
            link[q] = clone
            if cur != -1:
                link[cur] = clone
                last = cur
            else:
                last = clone
            times[last] += weight
    for state in sorted(range(1, len(nexts)), key=longest.__getitem__, reverse=True):
        times[link[state]] += times[state]
    return nexts, link, longest, times


def repeated(sequences: list[list[int]], weights: list[int], length: int) -> list[int]:
    """Of every sequence a bit mask of its windows that occur at least twice in all sequences."""
    nexts, link, longest, times = automaton(sequences, weights)
    times[0] = 2
    out = []
    for words in sequences:
        state, match, mask = 0, 0, 0
        for i, c in enumerate(words):
            state = nexts[state][c]
            match += 1
            if times[state] < 2:
                while times[state] < 2:
                    state = link[state]
                match = longest[state]
            if match >= length:
                mask |= 1 << (i - length + 1)
        out.append(mask)
    return out


def repeated_windows(documents: DataFrame, length: int = 35) -> DataFrame:
    """(key, s, mask): bit i of mask says that the window at word s + i of the text with that key is repeated.

    documents: key (long, equal for equal rows only) and text. length: K to K + 62, as windows of one unit are bits
    of one long. The result is a written table; all others are dropped.
    """
    if not K <= length <= K + 62:
        raise ValueError(f"length is {K} to {K + 62}")
    tables = Scratch(documents.sparkSession)

    def cut(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for a, _, _, _, _, words, first in each(batch.column("text"), lower=False):
                anchor, unit, row, s, count = units(words, first, length)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(unit.view(np.int64)), pa.array(keys[a + row]), pa.array(s * 64 + count)], ["anchor", "unit", "key", "p"])

    found = tables.write(documents.select("key", "text").mapInArrow(cut, "anchor long, unit long, key long, p long"), "substring-units")
    anchors = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("unit").alias("x"), F.max("unit").alias("y")).where("n > 1")
    shared = tables.write(found.join(anchors.select("anchor", (F.col("x") != F.col("y")).alias("mixed")), "anchor"), "substring-shared")
    tables.drop("substring-units")
    classes = shared.groupBy("anchor", "unit").agg(F.count("*").alias("m"), F.min("key").alias("key"), F.min_by("p", "key").alias("p"), F.bool_or("mixed").alias("mixed"))
    classes = tables.write(classes, "substring-classes")
    whole = shared.join(classes.where("m > 1").select("anchor", "unit"), ["anchor", "unit"], "left_semi")
    whole = whole.select("key", F.shiftright("p", 6).alias("s"), F.expr("shiftleft(1L, cast(p & 63 as int)) - 1").alias("mask"))
    whole = tables.write(whole, "substring-whole")
    tables.drop("substring-shared")

    mixed = classes.where("mixed")
    crowds = mixed.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > CROWD)
    mixed = mixed.join(crowds, "anchor", "left").select("anchor", "unit", "m", "key", "p", F.col("kinds").isNotNull().alias("crowded"))
    wanted = mixed.groupBy("key").agg(F.collect_list(F.struct("anchor", "unit", "m", "p", "crowded")).alias("units"))  # at most the units of a text
    n = mixed.count()

    def read(batches):
        for batch in batches:
            asked, keys = batch.column("units"), batch.column("key").to_pylist()
            for a, b, _, _, _, words, first in each(batch.column("text"), lower=False):
                out: list[list] = [[] for _ in range(7)]
                for row in range(a, b):
                    own = words[first[row - a] : first[row - a + 1]]
                    for u in asked[row].as_py():
                        s, width = u["p"] >> 6, u["p"] & 63
                        held = own[s : s + width + length - 1].tobytes()
                        for column, value in zip(out, (u["anchor"], u["unit"], u["m"], keys[row], s, u["crowded"], held), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:5]), pa.array(out[5], pa.bool_()), pa.array(out[6], pa.binary())], ["anchor", "unit", "m", "key", "s", "crowded", "words"])

    held = documents.join(wanted, "key").select("key", "text", "units").mapInArrow(read, "anchor long, unit long, m long, key long, s long, crowded boolean, words binary")
    held = tables.write(held, "substring-words")
    tables.drop("substring-classes")
    shards = max(1, n // SHARD_UNITS)

    def match(key, table):
        table = table.group_by(["anchor", "unit"], use_threads=False).aggregate([(c, "first") for c in ("m", "key", "s", "words")])  # repeated rows read a text twice
        names: dict[int, int] = {}
        sequences = [[names.setdefault(w, len(names)) for w in np.frombuffer(x.as_buffer(), np.int64).tolist()] for c in table.column("words_first").chunks for x in c]
        m = table.column("m_first").to_pylist()
        masks = [0 if n > 1 else mask for n, mask in zip(m, repeated(sequences, m, length), strict=True)]
        return pa.table({"key": table.column("key_first"), "s": table.column("s_first"), "mask": pa.array(masks, pa.int64())}).filter(pa.array([x != 0 for x in masks], pa.bool_()))

    apart = held.where("not crowded").drop("crowded").withColumn("shard", F.pmod("anchor", F.lit(shards)))
    matched = apart.groupBy("shard").applyInArrow(match, "key long, s long, mask long")

    def windows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                words = np.frombuffer(batch.column("words")[i].as_buffer(), U)
                starts = np.arange(len(words) - length + 1)
                row = batch.slice(i, 1).take(pa.array(np.zeros(len(starts), np.int64)))
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in ("anchor", "unit", "m", "key", "s")), pa.array(starts), pa.array(ranges(words, starts, starts + length).view(np.int64))], ["anchor", "unit", "m", "key", "s", "i", "window"])

    crowded = held.where("crowded").dropDuplicates(["anchor", "unit"]).mapInArrow(windows, "anchor long, unit long, m long, key long, s long, i long, window long")
    often = crowded.groupBy("anchor", "window").agg(F.sum("m").alias("n")).where("n > 1").select("anchor", "window")
    single = crowded.where("m = 1").join(often, ["anchor", "window"], "left_semi").select("key", F.col("s") + F.col("i"), F.lit(1).cast("long"))
    found = tables.write(whole.unionByName(matched).union(single), "substring-marks")
    tables.drop("substring-whole", "substring-words")
    return found


def keep_unrepeated(documents: DataFrame, length: int = 35, text: str = "text") -> DataFrame:
    """The rows with n_words, n_removed and kept: the words that no repeated window covers, joined by one space.

    A window is `length` consecutive words of one text; it is repeated if it also starts anywhere else,
    in the same text too. Null texts have no words; shorter texts lose none; repeated rows are repeated
    texts; an empty table gives no rows. Other columns stay as they are (n_words, n_removed and kept of
    the input give way). length is 6 to 68 words.
    """
    lean(documents.sparkSession)
    docs = documents.drop("n_words", "n_removed", "kept")
    others = [c for c in docs.columns if c != text]
    keyed = docs.withColumn("__windowed_text", F.coalesce(F.col(text).cast("string"), F.lit(""))).withColumn("__windowed_key", F.xxhash64("__windowed_text", *[F.col(c).cast("string") for c in others]))
    marks = repeated_windows(keyed.select(F.col("__windowed_key").alias("key"), F.col("__windowed_text").alias("text")), length)
    marks = marks.groupBy(F.col("key").alias("__windowed_key")).agg(F.collect_list(F.struct("s", "mask")).alias("__windowed_marks"))  # at most the windows of a text
    joined = keyed.join(marks, "__windowed_key", "left").drop("__windowed_key")
    names = docs.columns

    def remove(batches):
        for batch in batches:
            data, offsets = flat(batch.column("__windowed_text"))
            raw, marks = data.tobytes(), batch.column("__windowed_marks")
            n_words, n_removed, kept = [], [], []
            for i in range(batch.num_rows):
                words = raw[offsets[i] : offsets[i + 1]].split()
                n_words.append(len(words))
                if marks[i].is_valid:
                    cover = np.zeros(len(words) + 1, np.int64)
                    for m in marks[i].as_py():
                        at = m["s"] + np.flatnonzero((m["mask"] >> np.arange(64)) & 1)
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + length, -1)
                    words = list(compress(words, (np.cumsum(cover[:-1]) == 0).tolist()))
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], [*names, "n_words", "n_removed", "kept"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(remove, f"{schema}, n_words long, n_removed long, kept string")

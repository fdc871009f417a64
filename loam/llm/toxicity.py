"""Toxicity by compression distance: windows of a text under a toxic and an ordinary zstandard dictionary.

Both dictionaries are content that zstandard can refer back to. The ordinary one is text of ordinary
training documents; the toxic one is the same with, in front of it, words that training documents of
the toxic class hold far more often. A window that is shorter under the toxic dictionary speaks like
toxic text. How much each gain speaks for either class, and the curve from a text's evidence to its score
(and so where the threshold falls), are calibrated on the training sample.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import remainder, sample
from .shared import lean
from .text import flat

SAMPLE = 2000  #: labelled training texts of each class at most; the bound of what reaches the driver
WINDOW = 16  #: words
ORDINARY = 16 << 10  #: bytes of ordinary text
LEAST, MOST = -4, 9  #: gains in bytes that are told apart
WORDS = 100  #: over-represented words at most
STRIP = b".,;:!?#$%&*|\"'()[]"


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """(toxic, ordinary) dictionary content."""
    own, other = (Counter(w.strip(STRIP) for t in texts for w in set(tokens(t))) for texts in (toxic, ordinary))
    least = max(3, 0.02 * len(toxic))
    odd = [w for w, n in own.items() if w and n >= least and n * len(ordinary) > 8 * (other[w] + 0.5) * len(toxic)]
    odd.sort(key=lambda w: (own[w], w))
    base = bytearray()
    step = max(1, sum(map(len, ordinary)) // ORDINARY)
    for t in ordinary:  # an even share of every text
        words = tokens(t)
        base += b" ".join(words[: max(4, len(words) // step)]) + b" "
        if len(base) >= ORDINARY:
            break
    base = bytes(base[:ORDINARY])
    return b" " + b" ".join(odd[-WORDS:]) + b" " + base, base


class Distance:
    """Compressors with the two dictionaries; gains(text) are the differences of each window's lengths."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        import zstandard

        settings = zstandard.ZstdCompressionParameters(format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False, window_log=16, hash_log=14, chain_log=14, search_log=4, min_match=4, target_length=16, strategy=zstandard.STRATEGY_LAZY2)
        self.size = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=settings).compress for d in (ordinary, toxic)] if ordinary else None

    def gains(self, text: bytes) -> np.ndarray:
        """How many windows have each gain from LEAST to MOST (beyond them: the outermost)."""
        out, words = np.zeros(MOST - LEAST + 1), tokens(text)
        if self.size:
            plain, toxic = self.size
            for i in range(0, len(words), WINDOW):
                window = b" " + b" ".join(words[i : i + WINDOW]) + b" "
                out[min(MOST, max(LEAST, len(plain(window)) - len(toxic(window)))) - LEAST] += 1
        return out


def evidence(gains: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Of every gain the log of how much more often windows of toxic texts have it."""
    toxic, ordinary = (gains[labels == c].sum(axis=0) for c in (1, 0))
    prior = (toxic + ordinary) / (toxic + ordinary).sum()
    return np.log((toxic + 20 * prior + 0.1) / (toxic.sum() + 20)) - np.log((ordinary + 20 * prior + 0.1) / (ordinary.sum() + 20))


def shaped(gains: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Evidence of each text: in all, per window, of its largest gain, and 1."""
    gains = gains.reshape(-1, MOST - LEAST + 1)
    total, n = gains @ weight, np.maximum(gains.sum(axis=1), 1)
    largest = np.where(gains.any(axis=1), gains.shape[1] - 1 - np.argmax(gains[:, ::-1] > 0, axis=1), -LEAST)
    return np.stack([np.clip(total, -8, 8) / 4, np.clip(total / n, -2, 2), (largest + LEAST) / 4, np.ones(len(n))], axis=1)


def calibrate(x: np.ndarray, labels: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Weights of the logistic curve by Newton steps; shares: weight of each row of a class, as in all training rows."""
    w = np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        v = shares * p * (1 - p)
        step = np.linalg.solve((x * v[:, None]).T @ x + 1e-3 * len(x) * np.diag([1, 1, 1, 1e-3]), x.T @ (shares * (labels - p)) - 1e-3 * len(x) * np.array([*w[:3], 0]))
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = 4, held_out: int = 2, doc_id: str = "doc_id", text: str = "text") -> tuple[bytes, bytes, np.ndarray, np.ndarray]:
    """(toxic dictionary, ordinary dictionary, evidence of gains, calibration) from a bounded sample of training rows.

    Half of the sample makes the dictionaries and the other half the calibration.
    """
    got = sample(documents, labels, label, mod, held_out, SAMPLE, doc_id, text).collect()
    got.sort(key=lambda r: (r["place"], r["text"]))
    texts = [(r["label"], r["text"].encode()) for r in got]
    if len({y for y, _ in texts}) < 2:
        p = min(1 - 1e-9, max(1e-9, sum(y for y, _ in texts) / max(1, len(texts))))  # nothing to learn from: the share of toxic ones
        return b"", b"", np.zeros(MOST - LEAST + 1), np.array([0, 0, 0, np.log(p / (1 - p))])
    halves = [[t for i, t in enumerate(t for y, t in texts if y == c)] for c in (0, 1)]
    toxic, ordinary = dictionaries(halves[1][::2], halves[0][::2])
    distance = Distance(toxic, ordinary)
    y = np.array([0] * len(halves[0][1::2]) + [1] * len(halves[1][1::2]))
    x = np.array([distance.gains(t) for c in (0, 1) for t in halves[c][1::2]])
    counts = {r["label"]: r["n"] for r in labels.where(F.col(label).isin(0, 1)).where(remainder(doc_id, mod) != held_out).groupBy(F.col(label).cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    share = np.where(y == 1, counts.get(1, 1) / max(1, (y == 1).sum()), counts.get(0, 1) / max(1, (y == 0).sum()))
    weight = evidence(x, y)
    return toxic, ordinary, weight, calibrate(shaped(x, weight), y, share / share.mean())


def with_scores(documents: DataFrame, model: tuple[bytes, bytes, np.ndarray, np.ndarray], text: str = "text", to: str = "toxicity") -> DataFrame:
    """The rows with a column `to` (0 to 1), which gives way if they have one."""
    lean(documents.sparkSession)
    held, source = documents.sparkSession.sparkContext.broadcast(model), documents.drop(to)
    names = source.columns

    def run(batches):
        toxic, ordinary, weight, curve = held.value
        distance = Distance(toxic, ordinary)
        for batch in batches:
            data, offsets = flat(batch.column(text).cast(pa.string()))
            raw = data.tobytes()
            x = np.array([distance.gains(raw[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-shaped(x, weight) @ curve)))], [*names, to])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return source.mapInArrow(run, f"{schema}, `{to}` double")


def scores(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, mod: int = 4, held_out: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) of every row.

    Labels are learned from rows whose crc32(doc_id as text) mod `mod` isn't `held_out`. Null counts as
    the empty text, which gains nothing; repeated rows score alike; an empty table gives no rows; without
    both classes every row has the training share of toxic texts (0 without any), but for a billionth.
    """
    model = fit(documents, labels, "toxic", mod, held_out, doc_id, text)
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("held_out", remainder("doc_id", mod) == held_out)
    done = with_scores(docs, model).withColumnRenamed("toxicity", "score")
    return done.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

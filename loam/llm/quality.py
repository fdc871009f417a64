"""A quality classifier on supervised subword embeddings.

A text's features are its words and its byte 3- and 4-grams, hashed into one table of learned vectors;
their average goes through a linear layer and softmax. Training is stochastic gradient descent in numpy
over a bounded sample of labelled texts. As the layers are linear, a trained model scores a text with one
number per feature: the vector's product with the difference of the classes' output weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import remainder, sample
from .shared import lean
from .text import U, each, flat, slices

BITS = 17  #: of the number of vectors
WIDTH = 8
SAMPLE = 2500  #: labelled training texts of each class at most; the bound of what reaches the driver
EPOCHS = 4
GRAMS = (3, 4)


def buckets(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (((hashes + U(kind)) * U(0x9E3779B97F4A7C15)) >> U(64 - BITS)).astype(np.int32)


def grams(data: np.ndarray):
    """(n, bucket of the n bytes from each place on)."""
    wide = data.astype(U)
    for n in GRAMS:
        key = np.zeros(max(0, len(data) - n + 1), U)
        for i in range(n):
            key = (key << U(8)) | wide[i : i + len(key)]
        yield n, buckets(key, n << 40)


def features(data: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of one text."""
    return np.unique(np.concatenate([buckets(words, 0), *(g for _, g in grams(data))]), return_counts=True)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 3) -> tuple[np.ndarray, float]:
    """(a number per bucket, bias) of the logit of class 1, from (label, buckets, counts) of each text."""
    rng = np.random.default_rng(seed)
    table, size = np.zeros((1 << BITS, WIDTH), np.float32), np.full(1 << BITS, 1e-8, np.float32)
    out = rng.normal(0, 1 / np.sqrt(WIDTH), (2, WIDTH)).astype(np.float32)
    bias, steps = np.zeros(2, np.float32), np.full((2, WIDTH), 1e-8, np.float32)
    share = np.bincount([y for y, _, _ in rows], minlength=2) / max(1, len(rows))
    if not share.all():  # one class or none: its share, everywhere
        p = (share[1] * len(rows) + 1) / (len(rows) + 2)
        return np.zeros(1 << BITS, np.float32), float(np.log(p / (1 - p)))
    for epoch in range(EPOCHS):
        rate = 0.25 * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(rows)):
            y, at, count = rows[i]
            weight = (count / count.sum()).astype(np.float32) if len(count) else count.astype(np.float32)
            x = weight @ table[at]
            z = out @ x + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1  # the gradient of the loss by the class scores
            back = p @ out
            size[at] += weight * weight * float(back @ back)  # scaled by each vector's past gradients
            table[at] -= (rate * weight / np.sqrt(size[at]))[:, None] * back
            steps += np.outer(p, x) ** 2
            out -= rate * np.outer(p, x) / np.sqrt(steps)
            bias -= 0.05 * rate * p
    return table @ (out[1] - out[0]), float(bias[1] - bias[0])


def scores(documents: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 3, held_out: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score (of label 1) and predicted (score >= 0.5) of every row.

    Labels are learned from rows whose crc32(doc_id as text) mod `mod` isn't `held_out`. Null counts as
    the empty text, which has the score of no features; repeated rows score alike; an empty table gives no
    rows; without training rows every score is 0.5.
    """

    lean(documents.sparkSession)

    def extract(batches):
        for batch in batches:
            out: list[list] = [[], []]
            for a, b, data, _, _, words, first in each(batch.column("text"), lower=False):
                _, offsets = flat(batch.column("text").slice(a, b - a))
                offsets = offsets - offsets[0]
                for i in range(b - a):
                    at, count = features(data[offsets[i] : offsets[i + 1]], words[first[i] : first[i + 1]])
                    out[0].append(at.astype(np.int32).tobytes())
                    out[1].append(count.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("place"), *(pa.array(c, pa.binary()) for c in out)], ["label", "place", "at", "count"])

    got = sample(documents, labels, label, mod, held_out, SAMPLE, doc_id, text).mapInArrow(extract, "label int, place long, at binary, count binary").collect()
    got.sort(key=lambda r: (r["place"], r["at"]))
    model = documents.sparkSession.sparkContext.broadcast(train([(r["label"], np.frombuffer(r["at"], np.int32), np.frombuffer(r["count"], np.int32)) for r in got]))
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("held_out", remainder("doc_id", mod) == held_out)

    def score(batches):
        value, bias = model.value
        for batch in batches:
            column, out = batch.column("text"), []
            whole, offsets = flat(column)
            for a, b, data, _, _, words, first in each(column, lower=False):
                rows = offsets[a : b + 1] - offsets[a]
                total = np.append(0, np.cumsum(value[buckets(words, 0)]))
                logit, n = total[first[1:]] - total[first[:-1]], np.diff(first).astype(np.float64)
                for width, at in grams(data):
                    total = np.append(0, np.cumsum(value[at], dtype=np.float64))
                    start, end = np.minimum(rows[:-1], len(at)), np.maximum(rows[1:] - width + 1, 0)
                    end = np.maximum(start, end)
                    logit += total[end] - total[start]
                    n += end - start
                out.append(1 / (1 + np.exp(-(logit / np.maximum(n, 1) + bias))))
            p = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")

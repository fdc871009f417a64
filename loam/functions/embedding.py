"""The default embedding: signed feature hashing of the words of a text by the bytes of their MD5, in one pass."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

WORDS = 1 << 16  #: distinct words whose hashes a task remembers (about 10 MB); frequent ones come back soon


def small_batches(spark: SparkSession) -> None:
    """At most 1000 rows for a Python worker at once, as it keeps the memory of its largest batch; it stays set, as results are computed later."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def embedded(text: str | Column, width: int = 64, prefix: str = "") -> Column:
    """array<double>: of each word (letters a-z and digits, lower case) one place up or down; null for a null text."""

    @F.pandas_udf("array<double>")
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, int] = {}
        for part in texts:
            out = []
            for text in part:
                if text is None:
                    out.append(None)
                    continue
                words = re.findall("[a-z0-9]+", (prefix + text).lower())
                for w in set(words).difference(known):
                    known[w] = int.from_bytes(hashlib.md5(w.encode()).digest()[:3]) % (2 * width)  # a place, and above `width` downwards
                at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                counts = np.bincount(at, minlength=2 * width)
                out.append((counts[:width] - counts[width:]).astype(np.float64))
                if len(known) > WORDS:
                    known.clear()
            yield pd.Series(out, dtype=object)

    return embed(text)

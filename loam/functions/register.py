"""SQL functions for users of spark.sql, and factories for models that users plug in."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FUNCTIONS = {
    "estimate_tokens": "estimate_tokens(t STRING) RETURNS DOUBLE RETURN greatest(1D, size(filter(split(t, '\\\\s+'), w -> w <> '')) * 1.3D)",
    "confidence_level": "confidence_level(x DOUBLE) RETURNS STRING RETURN CASE WHEN x >= 95 THEN 'rock_solid' WHEN x >= 80 THEN 'high' WHEN x >= 60 THEN 'fuzzy' ELSE 'low' END",
    "text_jaccard": "text_jaccard(a STRING, b STRING) RETURNS DOUBLE RETURN size(array_intersect(split(lower(a), ' '), split(lower(b), ' '))) / size(array_union(split(lower(a), ' '), split(lower(b), ' ')))",
    "cosine_distance": "cosine_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN 1 - aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / (sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)))",
    "l2_distance": "l2_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))",
}


def register_functions(spark: SparkSession) -> list[str]:
    """Registers FUNCTIONS as temporary SQL functions and names them."""
    for body in FUNCTIONS.values():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body}")
    return list(FUNCTIONS)


def embedder(load: Callable[[], Callable[[list[str]], list[list[float]]]], prefix: str = ""):
    """A column function from text to a vector; the model is loaded once per task."""

    @F.pandas_udf("array<double>")
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in texts:
            yield pd.Series(model([prefix + t for t in part.fillna("")]))

    return embed


def reranker(load: Callable[[], Callable[[list[str], list[str]], list[float]]]):
    """A column function from a query and a text to a score."""

    @F.pandas_udf("double")
    def score(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for queries, texts in pairs:
            yield pd.Series(model(list(queries), list(texts)), dtype="float64")

    return score


CHUNK = "chunk_no int, chunk string"


def register_chunker(spark: SparkSession, name: str, chunk: Callable[[str], Iterable[str]]) -> None:
    """Makes a user's chunking strategy (a function from a text to its chunks) a table function of that name.

    In SQL: SELECT d.id, c.* FROM docs d, LATERAL name(d.text) c. chunk_no counts from 0; a null text has no chunks.
    """

    class Chunker:
        def eval(self, text: str):
            if text is not None:
                yield from enumerate(chunk(text))

    spark.udtf.register(name, F.udtf(Chunker, returnType=CHUNK, useArrow=True))


def chunked(docs: DataFrame, name: str, id_: str = "id", text: str = "text") -> DataFrame:
    """(id, chunk_no, chunk) of every document by a registered chunker."""
    if not re.fullmatch(r"\w+", name):
        raise ValueError(f"not a name of a chunker: {name}")
    own = docs.select(F.col(id_).alias("id"), F.col(text).alias("text"))
    return own.sparkSession.sql(f"SELECT d.id, c.chunk_no, c.chunk FROM {{docs}} d, LATERAL {name}(d.text) c", docs=own).withColumnRenamed("id", id_)

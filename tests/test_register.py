"""What users plug in: SQL functions, embedders, rerankers and chunkers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loam.functions import register as R
from loam.functions.embedding import embedded


def test_chunker_as_a_table_function(spark):
    R.register_chunker(spark, "halves", lambda text: [text[: len(text) // 2], text[len(text) // 2 :]] if text else [])
    df = spark.createDataFrame([(1, "abcd"), (2, None), (3, ""), (4, "é😀x")], "id long, text string")
    got = sorted(map(tuple, R.chunked(df, "halves").collect()))
    assert got == [(1, 0, "ab"), (1, 1, "cd"), (4, 0, "é"), (4, 1, "😀x")]
    df.createOrReplaceTempView("some_docs")
    assert spark.sql("SELECT d.id, c.chunk FROM some_docs d, LATERAL halves(d.text) c").count() == 4
    spark.catalog.dropTempView("some_docs")
    with pytest.raises(ValueError):
        R.chunked(df, "halves(d.text); --")


def test_sql_functions_and_models(spark):
    assert set(R.register_functions(spark)) == set(R.FUNCTIONS)
    assert spark.sql("SELECT confidence_level(81D) a, text_jaccard('a b', 'B c') b, cosine_distance(array(1D, 0D), array(0D, 2D)) c, l2_distance(array(0D, 3D), array(4D, 0D)) d, estimate_tokens('') e").first() == ("high", 1 / 3, 1.0, 5.0, 1.0)
    score = R.reranker(lambda: lambda queries, texts: [float(len(q) + len(t or "")) for q, t in zip(queries, texts, strict=True)])
    df = spark.createDataFrame([("ab", "c"), ("a", None)], "q string, t string")
    assert [r.s for r in df.select(score("q", "t").alias("s")).collect()] == [3.0, 1.0]
    own = R.embedder(lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], prefix="q: ")
    assert [r.v for r in df.select(own("t").alias("v")).collect()] == [[4.0, 1.0], [3.0, 1.0]]


def test_default_embedding(spark):
    df = spark.createDataFrame([("a b A, b-b",), (None,), ("",), ("é É",)], "text string")
    got = [r.v for r in df.select(embedded("text", 8).alias("v")).collect()]
    assert got[1] is None and got[2] == [0.0] * 8 == got[3] and sorted(map(abs, got[0]), reverse=True)[:2] in ([3.0, 2.0], [5.0, 0.0], [1.0, 0.0])
    assert [r.v for r in df.select(embedded("text", 8, "x ").alias("v")).collect()][2] == [r.v for r in spark.createDataFrame([("x",)], "text string").select(embedded("text", 8).alias("v")).collect()][0]
    assert df.select(F.size(embedded("text")).alias("n")).first().n == 64

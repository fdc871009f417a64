"""Rows from arrays: what the items are computed from is computed once, and rows without items give none."""

from pyspark.sql import functions as F

from loam.operators import chunking as C
from loam.operators import packers as P
from loam.sources.tables import unrolled


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_items_give_no_rows(spark):
    df = spark.createDataFrame([(1, ["a", None]), (2, []), (3, None)], "id int, xs array<string>")
    assert [tuple(r) for r in unrolled(df, "id", items=F.col("xs"), place="i", item="x").collect()] == [(1, 0, "a"), (1, 1, None)]


def test_a_text_is_cut_into_units_once(spark, tmp_path):
    spark.createDataFrame([(1, "a b\nc d\ne", "csv")], "doc_id int, text string, file_type string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    for packed in (P.row_packs(docs, 8), P.line_packs(docs, 8, 2), P.page_packs(docs, 8)):
        assert optimized(packed.select("doc_id", "chunk")).count("split(") == 1
    for packed in (P.row_packs(docs, 8), C.auto_chunks(docs, 8), C.line_chunks(docs, 8)):
        assert optimized(packed.select("doc_id", "chunk")).count("aggregate(") == 1


def test_columns_named_like_output_give_way(spark):
    docs = spark.createDataFrame([(1, "a b\nc d", "csv", "old", 7)], "doc_id int, text string, file_type string, chunk string, chunk_no int")
    assert [tuple(r) for r in C.auto_chunks(docs, 8).select("chunk_no", "chunk").collect()] == [(0, "a b\nc d")]
    assert [tuple(r) for r in C.unit_chunks(docs, F.split("chunk", " "), 8, "\n").select("chunk_no", "chunk").collect()] == [(0, "old")]

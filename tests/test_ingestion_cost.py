"""What ingestion costs: the lower-case text of a chunk is made once, and a Python worker gets few rows at once."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loam.operators import ingestion as I
from loam.operators import memory_search as S


@pytest.fixture
def batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    yield
    spark.conf.set(key, before)


def test_a_chunk_is_lowered_once(spark, batches):
    docs = spark.createDataFrame([(1, "Maybe so. It could be 3.5, Obviously.", "txt", "f1")], "id long, text string, file_type string, file_name string")
    made = I.enriched_chunks(docs)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    row = made.first()
    assert (round(row["confidence"], 6), round(row["risk"], 6)) == (0.55, 0.35)  # the context has over 50 characters


def test_models_get_few_rows_at_once(spark, batches):
    @F.pandas_udf("array<double>")
    def rows(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(len(texts))]] * len(texts))

    df = spark.range(5000).repartition(1).select("id", F.lit("a").alias("text"))
    assert S.with_fallback(df, {"primary": rows("text")}).agg(F.max(F.get("v", F.lit(0)))).first()[0] <= 1000

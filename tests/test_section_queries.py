"""Queries that mark every fifth line with a title take no line of a text for one."""

import duckdb
import pytest

from loam.plans import all_queries
from test_queries import rows


@pytest.mark.parametrize("name", ["chunk_section", "chunk_section_bodies"])
def test_lines_like_headers_stay_text(spark, tmp_path, name):
    texts = ["a b\n12 Of the house.\nc\n# title 9\nd\ne\nf", "4 Ab\nx\ny\nz\nw\n## B\nv", "one line"]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").write.parquet(path)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    queries, oracles = all_queries()
    assert rows(queries[name](spark, str(tmp_path)).toPandas()) == rows(connection.execute(oracles[name]).df())

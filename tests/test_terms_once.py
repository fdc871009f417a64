"""The terms and names of a text are looked for once."""

from loam.operators import graph as G
from loam.operators import retrieval as R


def test_one_pass_over_a_text(spark, tmp_path):
    spark.createDataFrame([(1, "Ada met Bo. Ada left"), (2, "the"), (3, None)], "id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    terms, names = R.postings(docs, "id", "text"), G.mentions(docs, "id", "text")
    for df in (terms, names):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1
    assert sorted(tuple(r) for r in terms.collect()) == [(1, "ada"), (1, "bo"), (1, "left"), (1, "met")]
    assert sorted(tuple(r)[:3] for r in names.collect()) == [(1, "Ada", 1), (1, "Bo", 2)]

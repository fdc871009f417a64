"""A corpus through toxicity filter, near-duplicate join, substring removal, redaction and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return docs' columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import jaccard, packing, personal, substrings, toxicity
from loam.llm.shared import Scratch, small, written

REJECTED = 0.3  #: toxicity from which a document goes


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below REJECTED; null and empty texts are scored as empty."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.with_scores(docs, model, to="__toxicity").where(F.col("__toxicity") < REJECTED).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones: that with the smallest id (those without id come last), of rows
    with one id that with the smallest text hash, of equal rows any. Documents without words all stay."""
    found = jaccard.classes(docs).where("class is not null")
    row = F.struct(F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("h"))
    first = found.groupBy("class").agg(F.min(row).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    marked = found.join(first, "class").select("doc_id", "h", (row == F.col("first")).alias("stays"))
    marked = written(marked.groupBy("doc_id", "h").agg(F.bool_or("stays").alias("stays"), F.count("*").alias("rows")).where("not stays or rows > 1"), "pipeline-marked")
    keyed = docs.withColumn("__id", F.col("doc_id")).withColumn("__h", F.xxhash64("text"))
    marks = small(marked.select(F.col("doc_id").alias("__id2"), F.col("h").alias("__h2"), "stays").withColumnRenamed("stays", "__stays"), 24)
    joined = keyed.join(marks, F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__h") == F.col("__h2")) & F.col("text").isNotNull(), "left")
    left = joined.where("coalesce(__stays, true)")
    once = left.where("__stays").dropDuplicates(["__id", "__h"])  # equal rows of a class: one stays
    return left.where("__stays is null").unionByName(once).select(*docs.columns)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated windows; a text that loses none stays as it is."""
    own = docs.select(*[F.col(c).alias(f"__{c}") for c in docs.columns])
    done = substrings.keep_unrepeated(own, text="__text")
    return _changed(docs, done, F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("__text")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every span of personal data replaced by its kind."""
    own = docs.select(*[F.col(c).alias(f"__{c}") for c in docs.columns])
    return _changed(docs, personal.with_spans(own, text="__text", redact=True), F.col("__text"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


def _changed(docs: DataFrame, done: DataFrame, text: Column) -> DataFrame:
    """docs' columns from those of `done`, which are behind two underscores; n_chars follows the text."""
    new = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return done.select(*[new.get(c, F.col(f"__{c}")).alias(c) for c in docs.columns])


STAGES = [
    ("toxicity", toxicity_filter),
    ("ngram_jaccard", near_duplicates),
    ("substring_dedup", repeated_substrings),
    ("pii", personal_data),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None  # SQL states neither the classifiers nor the tokenizer; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again; a stage's table goes when the next one stands."""
    docs, tables = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for (name, stage), before in zip(STAGES[:-1], [None, *STAGES], strict=False):
        docs = tables.write(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            tables.drop(f"pipeline-{before[0]}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Documents to stored memories in one lineage: chunks, their context, tags, estimates and vectors, entities and their edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.embedding import embedded, small_batches
from . import chunking, enrichment, graph

SIZE = 128  #: tokens of a chunk


def enriched_chunks(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(memory_id, chunk_id, chunk_no, strategy, chunk, context, tags, confidence, risk, tokens, v) of (id, text, file_type, file_name).

    Stateless: the same on a table and on a stream. chunk_id is <memory>_chunk_<i>, i from 0. Documents without words
    have no chunks; a null type counts as plain text. What a chunk is told apart by, not its words, is its context.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col("id").alias("memory_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("file_type", F.lit("txt")).alias("file_type"), "file_name")
    cut = chunking.auto_chunks(own, size).withColumn("low", F.lower("chunk")).withColumn("tags", enrichment.tags("chunk", "low"))
    about = {"file": F.col("file_name"), "type": F.col("strategy"), "chunk": F.col("chunk_no") + 1, "content": F.when(F.size("tags") > 0, F.array_join("tags", ", "))}
    out = cut.withColumn("context", enrichment.context(about)).withColumn("chunk_id", F.concat(F.col("memory_id").cast("string"), F.lit("_chunk_"), F.col("chunk_no").cast("string")))
    out = out.withColumns({"confidence": enrichment.confidence("chunk", "context", "low"), "risk": enrichment.risk("chunk", "low"), "tokens": F.greatest(F.lit(1.0), chunking.word_count(F.col("chunk")) * 1.3)})
    return out.select("memory_id", "chunk_id", "chunk_no", "strategy", "chunk", "context", "tags", "confidence", "risk", "tokens", embedded("chunk").alias("v"))


def entities_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mentions, edges): (memory_id, name, ordinal) of every document's entities, and (memory_id, src, dst) of those that follow each other."""
    found = graph.mentions(docs.select(F.col("id").alias("memory_id"), "text"), "memory_id", "text")
    return found.select("memory_id", "name", "ordinal"), graph.co_mentions(found, "memory_id")


def stored_documents(docs: DataFrame, chunks: DataFrame, mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """A row for every document: what was stored of it, and its quality; `success` where it has chunks.

    chunks is read twice or more: pass a written table. Rows of one id count together.
    """
    quality = enrichment.document_quality(chunks, "memory_id").join(chunks.groupBy("memory_id").agg(F.round(F.sum("tokens"), 4).alias("tokens"), F.count("v").alias("vectors")), "memory_id")
    out = docs.select(F.col("id").alias("memory_id")).distinct()
    for part in (quality, mentions.groupBy("memory_id").agg(F.count("*").alias("entities")), edges.groupBy("memory_id").agg(F.count("*").alias("relationships"))):
        out = out.join(part, "memory_id", "left")
    counts = ["chunks", "vectors", "entities", "relationships"]
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts}).withColumn("success", F.col("chunks") > 0)

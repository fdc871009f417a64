"""Bounded samples of labelled texts for the classifiers that are trained here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str, mod: int):
    """crc32 of the id as text, modulo `mod`; a null id has remainder -1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % mod, F.lit(-1))


def sample(documents: DataFrame, labels: DataFrame, label: str, mod: int, held_out: int, most: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(label, text) of at most `most` training rows of each class, chosen by a hash of the id.

    Held-out ids and labels other than 0 and 1 are left out; of several labels of one id the largest counts.
    """
    of = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and id is not null")
    of = of.where(remainder("id", mod) != held_out).groupBy("id").agg(F.max("label").alias("label")).withColumn("place", F.xxhash64("id"))
    chosen = None
    for c in (0, 1):  # a top-n by hash for each class: small tables, at most `most` rows
        part = of.where(F.col("label") == c).orderBy("place").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    docs = documents.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = docs.join(F.broadcast(chosen), "id").withColumn("h", F.xxhash64("text"))  # at most 2 * most rows of 20 bytes
    # ids may stand in many rows: of each the text with the smallest hash counts, so that the bound holds for rows too
    one = rows.groupBy("id").agg(F.min("h").alias("h"))
    return rows.join(F.broadcast(one), ["id", "h"]).dropDuplicates(["id", "h"]).select("label", "place", "text")

"""Removal of lines that other documents hold too, in DataFrame functions alone.

A line's key is the line without white space at its ends, in lower case (A-Z only). Keys are counted by hash; keys that
several documents hold stay in the smallest document, and lines are put together again by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, written

SPACE = " \t\n\x0b\x0c\r"
#: A key with more than this share of all repeated lines is dealt to several tasks; so at most 1 / HOT keys are broadcast.
HOT = 1 / 4096
KEY = ["h", "g"]


def key_of(line: Column) -> Column:
    """The line that counts: stripped at both ends, A-Z in lower case."""
    own = F.btrim(line, F.lit(SPACE))
    plain = F.translate(own, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(own) == F.char_length(own), F.lower(own)).otherwise(plain)  # lower() only where all is ASCII


def lines_of(documents: DataFrame, doc_id: str, text: str, least: int) -> DataFrame:
    """(doc, row, at, h, g): every line with a key of at least `least` code points, by two hashes of the key.

    `row` tells rows of one document apart by a hash of their text; equal rows need not be told apart.
    """
    own = documents.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(text).alias("row"), F.posexplode(F.split(text, "\n", -1)).alias("at", "line"))
    keyed = own.select("doc", "row", "at", key_of(F.col("line")).alias("key")).where(F.char_length("key") >= least)
    return keyed.select("doc", "row", "at", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"))


def shared_keys(lines: DataFrame, documents: int) -> DataFrame:
    """(h, g, keeper, n): keys in at least `documents` documents, the smallest of these, and how many lines have the key.

    For two documents the extremes decide; for more, documents are counted after equal (key, document) rows became one.
    """
    if documents <= 2:
        found = lines.groupBy(*KEY).agg(F.min("doc").alias("keeper"), F.max("doc").alias("last"), F.bool_or(F.col("doc").isNull()).alias("nameless"), F.count("*").alias("n"))
        several = F.lit(True) if documents < 2 else (F.col("keeper") < F.col("last")) | F.col("nameless")
    else:
        once = lines.groupBy(*KEY, "doc").agg(F.count("*").alias("n"))
        found = once.groupBy(*KEY).agg(F.min("doc").alias("keeper"), F.count("*").alias("documents"), F.sum("n").alias("n"))
        several = F.col("documents") >= documents
    return found.where(F.col("keeper").isNotNull() & several).select(*KEY, "keeper", "n")


def drop_shared_lines(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 10, threshold: int = 2) -> DataFrame:
    """Every row of `documents` with n_lines, n_dropped and kept (its other lines, joined by line feeds).

    Keys of at least `least` code points (1 or more) in at least `threshold` documents lose all lines but those in the
    smallest id. Rows of one id are one document. Rows without id count together as one document after all others: what
    they share with an id goes, what only they hold stays. Null texts are empty; an empty text is one empty line. Equal
    rows get equal results. Columns n_lines, n_dropped and kept of `documents` are replaced; an empty table gives no rows.

    Only hashes of lines are shuffled to be counted and marked; hot keys are dealt to tasks in proportion to their
    lines. Texts move once, to meet the positions that they lose. The table of repeated keys goes before this returns;
    that of lost positions stays in the scratch folder, as the result reads it.
    """
    if least < 1:
        raise ValueError("an empty line has no key: least must be 1 or more")
    held = Scratch(documents.sparkSession)
    known = ["n_lines", "n_dropped", "kept"]
    own = documents.drop(*known).withColumn("__of_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    lines = lines_of(own, doc_id, "__of_text", least)
    try:
        keys = held.write(shared_keys(lines, threshold), "lines-keys")
        share = max(1, int((keys.agg(F.sum("n")).first()[0] or 0) * HOT))
        parts = F.ceil(F.col("n") / share).cast("int")
        hot = keys.where(F.col("n") > share).select(*KEY, parts.alias("parts"))  # at most 1 / HOT rows, as each has over HOT of all lines
        salted = keys.select(*KEY, "keeper", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > share, parts - 1).otherwise(0))).alias("part"))
        dealt = lines.join(F.broadcast(hot), KEY, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc", "row", "at"), "parts"), F.lit(0)).cast("int"))
        gone = dealt.join(salted, [*KEY, "part"]).where(~F.col("doc").eqNullSafe(F.col("keeper")))
        lost = written(gone.groupBy("doc", "row").agg(F.collect_set("at").alias("__of_lost")), "lines-lost")
    finally:
        held.drop_all()
    lost = lost.select(F.col("doc").alias("__of_doc"), F.col("row").alias("__of_hash"), "__of_lost")
    at = F.col(doc_id).cast("long").eqNullSafe(F.col("__of_doc")) & (F.xxhash64("__of_text") == F.col("__of_hash"))
    out = own.join(lost, at, "left").withColumn("__of_lines", F.split("__of_text", "\n", -1))
    stays = F.array_except(F.sequence(F.lit(0), F.size("__of_lines") - 1), F.col("__of_lost"))
    kept = F.when(F.col("__of_lost").isNull(), F.col("__of_text")).otherwise(F.array_join(F.transform(stays, lambda i: F.get("__of_lines", i)), "\n"))
    size = F.when(F.col("__of_lost").isNull(), 0).otherwise(F.size("__of_lost"))
    out = out.withColumns({"n_lines": F.size("__of_lines").cast("long"), "n_dropped": size.cast("long"), "kept": kept})
    return out.drop("__of_text", "__of_lines", "__of_lost", "__of_doc", "__of_hash")

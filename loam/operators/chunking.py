"""Documents to chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import unrolled, words


def estimated_tokens(text: str | Column) -> Column:
    """1.3 tokens a word, one at least."""
    return F.greatest(F.lit(1.0), F.size(words(text)) * 1.3)


def token_chunks(docs: DataFrame, size: int, overlap: int = 0, text: str = "text") -> DataFrame:
    """Windows of the words that make `size` tokens; the next one starts with the last `overlap` words."""
    width = -(-10 * size // 13)
    own = docs.withColumn("__w", words(text)).where(F.size("__w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("__w") - 1 - overlap, F.lit(0)), F.lit(width - overlap))
    return unrolled(own, "*", items=starts, place="chunk_no", item="__s").withColumn("chunk", F.array_join(F.slice("__w", F.col("__s") + 1, width), " ")).drop("__w", "__s")


def char_chunks(docs: DataFrame, size: int, overlap: int = 0, text: str = "text") -> DataFrame:
    """Windows of `size` characters, `size - overlap` apart; blank ones are left out."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1 - overlap, F.lit(0)), F.lit(size - overlap))
    out = unrolled(docs, "*", items=starts, place="chunk_no", item="__s").withColumn("chunk", F.substr(F.col(text), F.col("__s") + 1, F.lit(size))).drop("__s")
    return out.where(F.trim("chunk") != "")


def packed(sizes: Column, budget: int | Column) -> Column:
    """Greedy groups of consecutive units: array of (first, last) indexes; a unit larger than the budget is alone.

    sizes: array<int> in units where sums are exact; the fold carries integers only.
    """
    empty = F.array().cast("array<struct<first:int,last:int>>")
    start = F.struct(empty.alias("done"), F.lit(0).alias("first"), F.lit(0).alias("i"), F.lit(0).alias("held"))

    def step(acc, n):
        full = (acc["held"] > 0) & (acc["held"] + n > budget)
        closed = F.struct(acc["first"].alias("first"), (acc["i"] - 1).alias("last"))
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(closed))).otherwise(acc["done"]).alias("done"), F.when(full, acc["i"]).otherwise(acc["first"]).alias("first"),
            (acc["i"] + 1).alias("i"), F.when(full, n).otherwise(acc["held"] + n).alias("held"),
        )

    finish = lambda acc: F.when(acc["i"] > 0, F.concat(acc["done"], F.array(F.struct(acc["first"].alias("first"), (acc["i"] - 1).alias("last"))))).otherwise(acc["done"])
    return F.aggregate(sizes, start, step, finish)


def unit_chunks(docs: DataFrame, units: Column, size: int, glue: str, taken: Column | None = None) -> DataFrame:
    """Chunks of whole units of up to `size` tokens: chunk_no, first_unit, last_unit, chunk.

    13 * words <= 10 * size states 1.3 * words <= size in integers. taken: words that each chunk holds besides its units.
    """
    budget = F.lit(10 * size) if taken is None else F.lit(10 * size) - 13 * taken
    own = docs.withColumn("__u", F.filter(units, lambda u: F.trim(u) != ""))
    own = own.withColumn("__c", packed(F.transform("__u", lambda u: 13 * F.size(words(u))), budget))
    pack = lambda r: F.struct(r["first"].alias("first_unit"), r["last"].alias("last_unit"), F.array_join(F.slice("__u", r["first"] + 1, r["last"] - r["first"] + 1), glue).alias("chunk"))
    own = own.withColumn("__p", F.transform("__c", pack)).drop("__u", "__c", "chunk_no", "first_unit", "last_unit", "chunk")
    return unrolled(own, "*", items=F.col("__p"), place="chunk_no", item="__r").select("*", "__r.*").drop("__p", "__r")


def line_chunks(docs: DataFrame, size: int, text: str = "text") -> DataFrame:
    return unit_chunks(docs, F.split(text, "\n"), size, "\n")


def is_header(line: Column, place: Column) -> Column:
    return line.rlike(r"^#{1,6}\s+\S")


def sections(docs: DataFrame, id_: str, text: str = "text", header: Callable[[Column, Column], Column] = is_header) -> DataFrame:
    """One row per section: a header line (# to ######) and the lines below it, in order; section 0 has no header.

    header: whether a line is one, by its text and place (from 0).
    """
    lines = F.split(text, "\n")
    heads = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: header(F.element_at(lines, i), i - 1))
    starts = F.when(F.try_element_at(heads, F.lit(1)) == 1, heads).otherwise(F.concat(F.array(F.lit(1)), heads))
    own = docs.select(id_, lines.alias("__l"), starts.alias("__s"))
    own = unrolled(own, id_, "__l", "__s", items=F.col("__s"), place="section", item="__a")
    end = F.coalesce(F.try_element_at("__s", F.col("section") + 2), F.size("__l") + 1)
    first = F.element_at("__l", F.col("__a"))
    titled = header(first, F.col("__a") - 1)
    return own.select(id_, "section", F.when(titled, F.regexp_replace(first, r"^#+\s+", "")).otherwise("").alias("title"), (end - F.col("__a") - F.when(titled, 1).otherwise(0)).alias("n_lines"))


def strategy(text: str, kind: str) -> Column:
    """The chunking that suits a document, by its type, length and blank-line breaks."""
    breaks = F.size(F.split(text, r"\n\s*\n")) - 1
    by_type = F.when(F.col(kind) == "csv", "row").when(F.col(kind) == "json", "object").when(F.col(kind) == "pdf", "page").when(F.col(kind).isin("md", "html"), "section")
    return by_type.when(F.length(text) < 1000, "token").when(breaks >= 3, "paragraph").otherwise("semantic")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def auto_chunks(docs: DataFrame, size: int, text: str = "text", kind: str = "file_type") -> DataFrame:
    """Every document by its own strategy, as strategy, chunk_no and chunk: one pass, in which the strategy picks the units.

    token: words, as many as `token_chunks` takes; paragraph: paragraphs, or their sentences if one is larger than a
    chunk; semantic: sentences; section: lines; row: lines below a header that stands on every chunk and counts; object:
    items of a JSON array, else lines; page: pages. Units are whole, and their words are counted once.
    """
    how, t = F.col("strategy"), F.col(text)
    lines, filled = F.split(t, "\n"), lambda units: F.filter(units, lambda u: F.trim(u) != "")
    items, bare = F.from_json(t, "array<string>"), lambda x: F.regexp_replace(x, r'[\s,\[\]"\\]', "")
    sentences = lambda p: F.when(13 * word_count(p) > 10 * size, F.split(p, r"[.!?]+\s+")).otherwise(F.array(p))
    units = F.when(how == "token", words(t)).when(how == "paragraph", filled(F.flatten(F.transform(F.split(t, r"\n\s*\n"), sentences)))).when(how == "semantic", filled(F.split(t, r"[.!?]+\s+")))
    units = units.when(how == "object", filled(F.when(bare(F.array_join(items, "")) == bare(t), items).otherwise(lines))).when(how == "page", filled(F.split(t, "\f"))).otherwise(filled(lines))
    own = docs.withColumn("strategy", strategy(text, kind)).withColumn("__u", units)
    own = own.withColumn("__h", F.when((how == "row") & (F.size("__u") > 1), F.get("__u", F.lit(0)))).withColumn("__u", F.when(F.col("__h").isNotNull(), F.slice("__u", 2, F.size("__u"))).otherwise(F.col("__u")))
    sizes = F.when(how == "token", F.array_repeat(F.lit(13), F.size("__u"))).otherwise(F.transform("__u", lambda u: 13 * word_count(u)))
    budget = F.when(how == "token", 13 * -(-10 * size // 13)).otherwise(10 * size - 13 * F.coalesce(word_count(F.col("__h")), F.lit(0)))
    own = own.withColumn("__n", sizes).withColumn("__b", budget)
    glue = F.when(how == "token", " ").when(how == "paragraph", "\n\n").when(how == "semantic", ". ").otherwise("\n")
    cut = lambda r: F.call_function("array_join", F.slice("__u", r["first"] + 1, r["last"] - r["first"] + 1), glue)
    own = own.withColumn("__p", F.transform(packed(F.col("__n"), F.col("__b")), cut)).drop("__u", "__n", "__b", "chunk_no", "chunk")  # packed before they are rows, so that no row holds a whole text
    out = unrolled(own, "*", items=F.col("__p"), place="chunk_no", item="chunk").drop("__p")
    return out.withColumn("chunk", F.when(F.col("__h").isNotNull(), F.concat("__h", F.lit("\n"), "chunk")).otherwise(F.col("chunk"))).drop("__h")


def chunk_stats(chunks: DataFrame, *keys: str) -> DataFrame:
    tokens = estimated_tokens("chunk")
    return chunks.groupBy(*keys).agg(F.count("*").alias("chunks"), F.round(F.sum(tokens), 4).alias("tokens"), F.round(F.avg(F.length("chunk")), 6).alias("mean_chars"))

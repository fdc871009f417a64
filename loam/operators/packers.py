"""Whole units of a text packed into chunks: lines, paragraphs, sentences, sections, pages, slides, objects, items, rows, chapters.

Every packer is one pass over its rows without a shuffle: the text is cut into units whose words are counted once, a
fold over these counts finds the runs of units, and each run becomes a row. A unit is never split, but a paragraph or
chapter larger than a chunk counts as its sentences; one unit beyond the size is a chunk alone. Null and blank texts
give no chunk. Columns of the input named like an output column give way. Sizes are in estimated tokens (1.3 a word).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import unrolled, words
from .chunking import word_count

BLANK = " \t\n\r\x0b\x0c"
SENTENCE = r"[.!?]+\s+"
# What begins a new topic, and what is a header
TRANSITIONS = (
    "however", "meanwhile", "furthermore", "moreover", "additionally", "consequently", "therefore", "in conclusion",
    "finally", "next", "first", "second", "third", "lastly", "on the other hand",
)
TOPICS = ("new topic", "moving on", "let's discuss", "another")
HEADER = r"^(#{1,6}\s+.+|[0-9]+\.?\s+[A-Z][^.\n]*\.?)\s*$"
INTRODUCTION = "Introduction"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK))


def unit(text: Column, part: bool = False, bar: Column | None = None, label: Column | None = None, turns: bool = False) -> Column:
    """text with its words, whether it is part of a larger unit, begins one (bar) or a topic (turn), and its label."""
    turn = F.lower(text).rlike(f"^(?:{'|'.join(TRANSITIONS)})|{'|'.join(TOPICS)}") if turns else F.lit(False)  # one pass over the lower-case text
    return F.struct(text.alias("text"), word_count(text).alias("n"), F.lit(part).alias("part"), (F.lit(False) if bar is None else bar).alias("bar"), turn.alias("turn"), (F.lit(None).cast("string") if label is None else label).alias("label"))


def units(texts: Column, **more) -> Column:
    """Stripped texts that are not blank as units; their place (from 1) is their label."""
    every = F.transform(texts, lambda t, i: unit(stripped(t), label=(i + 1).cast("string"), **more))
    return F.filter(every, lambda u: u["n"] > 0)


def sentences(text: Column, bar: bool = False, label: Column | None = None, turns: bool = False) -> Column:
    """Sentences as parts; with `bar`, the first of them begins a new run."""
    kept = F.filter(F.transform(F.split(text, SENTENCE), stripped), lambda s: s != "")
    return F.transform(kept, lambda s, i: unit(s, part=True, bar=(i == 0) if bar else None, label=label, turns=turns))


def runs(of: str, size: int, overlap: int, semantic: bool, lines: bool, taken: Column) -> Column:
    """Runs of consecutive units of the column `of` as (first, last, lead); lead is what a run repeats of the one before.

    A run is full when the next unit would exceed `size`. Parts of a semantic packer end a run once it has reached
    `size`, or after the beginning of a topic in its second half. lead: words, with `lines` whole units. Runs that a
    large unit begins or ends repeat nothing. The fold carries integers only.
    """
    zero, no = F.lit(0), F.lit(False)
    start = F.struct(F.array().cast("array<struct<first:int,last:int,lead:int>>").alias("done"), zero.alias("first"), zero.alias("i"), zero.alias("held"), zero.alias("lead"), no.alias("part"), no.alias("turn"))
    closed = lambda a: F.concat(a["done"], F.array(F.struct(a["first"].alias("first"), (a["i"] - 1).alias("last"), a["lead"].alias("lead"))))

    def step(a, u):
        fresh = u["bar"] | (u["part"] != a["part"])
        full = 13 * (a["held"] + u["n"] + taken) > 10 * size
        if semantic:
            full = F.when(u["part"], (13 * a["held"] >= 10 * size) | (a["turn"] & (13 * a["held"] > 5 * size))).otherwise(full)
        begins = (a["i"] > 0) & (fresh | full)
        lead = F.least(F.lit(overlap), a["i"] - a["first"] + a["lead"] if lines else a["held"])
        lead = F.when(fresh, 0).otherwise(lead)
        held = F.aggregate(F.slice(of, a["i"] - lead + 1, lead), zero, lambda s, x: s + x["n"]) if lines and overlap else lead
        return F.struct(
            F.when(begins, closed(a)).otherwise(a["done"]).alias("done"), F.when(begins, a["i"]).otherwise(a["first"]).alias("first"), (a["i"] + 1).alias("i"),
            (F.when(begins, held).otherwise(a["held"]) + u["n"]).alias("held"), F.when(begins, lead).otherwise(a["lead"]).alias("lead"), u["part"].alias("part"), u["turn"].alias("turn"),
        )

    return F.aggregate(of, start, step, lambda a: F.when(a["i"] > 0, closed(a)).otherwise(a["done"]))


def packs(docs: DataFrame, of: Column, size: int, glue: str, overlap: int = 0, semantic: bool = False, lines: bool = False, taken: Column | None = None) -> DataFrame:
    """The rows with chunk_no, first_unit, last_unit, lead, labels and chunk; parts of large units are joined by a space."""
    if size < 1 or overlap < 0:
        raise ValueError("size is 1 or more, and overlap 0 or more")
    own = docs.drop("chunk_no", "first_unit", "last_unit", "lead", "labels", "chunk", "n_chunks").withColumn("__u", of).withColumn("__t", F.lit(0) if taken is None else taken)
    own = own.withColumn("__r", runs("__u", size, overlap, semantic, lines, F.col("__t"))).withColumn("n_chunks", F.size("__r"))

    def units_of(x):
        first, last, lead = x["first"], x["last"], x["lead"]
        near = F.slice("__u", first - lead + 1, lead) if lines else F.slice("__u", F.greatest(first - overlap + 1, F.lit(1)), F.least(first, F.lit(overlap)))  # every unit has a word, so that as many units hold these words
        return F.struct(x.alias("x"), F.slice("__u", first + 1, last - first + 1).alias("k"), (near if overlap else F.slice("__u", 1, 0)).alias("near"))

    def pack(y):
        x, k, lead = y["x"], y["k"], y["x"]["lead"]
        part = F.get(k, F.lit(0))["part"]
        between = F.when(part, " ").otherwise(glue)
        chunk = F.call_function("array_join", k["text"], between)
        if overlap:
            before = F.array_join(y["near"]["text"], glue)
            if not lines:
                near = words(F.array_join(y["near"]["text"], " "))
                before = F.array_join(F.slice(near, F.greatest(F.size(near) - lead + 1, F.lit(1)), lead), " ")
            chunk = F.when(lead > 0, F.concat(before, between, chunk)).otherwise(chunk)
        labels = F.when(part, F.slice(k["label"], 1, 1)).otherwise(k["label"])
        return F.struct(x["first"].alias("first_unit"), x["last"].alias("last_unit"), lead.alias("lead"), labels.alias("labels"), chunk.alias("chunk"))

    own = own.withColumn("__p", F.transform(F.transform("__r", units_of), pack)).drop("__u", "__t", "__r")  # packed before they are rows, so that no row holds a whole text
    return unrolled(own, "*", items=F.col("__p"), place="chunk_no", item="__x").select("*", "__x.*").drop("__p", "__x")


def line_packs(docs: DataFrame, size: int, overlap: int = 0, text: str = "text") -> DataFrame:
    """Lines; the last `overlap` lines of a chunk begin the next one."""
    return packs(docs, units(F.split(text, "\n")), size, "\n", overlap, lines=True)


def _paragraphs(text: Column, size: int) -> Column:
    kept = F.filter(F.transform(F.split(text, "\n\n"), stripped), lambda p: p != "")
    return F.flatten(F.transform(kept, lambda p: F.when(13 * word_count(p) > 10 * size, sentences(p, bar=True)).otherwise(F.array(unit(p)))))


def paragraph_packs(docs: DataFrame, size: int, overlap: int = 0, text: str = "text") -> DataFrame:
    """Paragraphs, which blank lines part; one larger than a chunk is packed by itself, as sentences. overlap: words."""
    return packs(docs, _paragraphs(F.col(text), size), size, "\n\n", overlap)


def semantic_packs(docs: DataFrame, size: int, overlap: int = 0, text: str = "text") -> DataFrame:
    """Sentences, up to `size` or to one that turns to a new topic beyond half of it. overlap: words."""
    return packs(docs, sentences(F.col(text), turns=True), size, " ", overlap, semantic=True)


def is_header(line: Column, place: Column) -> Column:
    return stripped(line).rlike(HEADER)


def section_packs(docs: DataFrame, size: int, overlap: int = 0, text: str = "text", header: Callable[[Column, Column], Column] = is_header) -> DataFrame:
    """Sections below their headers, with section (from 0), title and n_chunks; a larger one is packed by paragraphs.

    Sections without text are left out; a text with one section or none is packed by paragraphs without a title.
    header: whether a line is one, by its text and place (from 0).
    """
    heads = F.filter(F.transform("__l", lambda x, i: F.when(header(x, i), i + 1)), lambda i: i.isNotNull())
    own = docs.drop("section", "title").withColumn("__l", F.split(text, "\n")).withColumn("__s", F.concat(F.array(F.lit(0)), heads))

    def section(s, k):
        end = F.coalesce(F.try_element_at("__s", k + 2), F.size("__l") + 1)
        title = F.when(s == 0, INTRODUCTION).otherwise(stripped(F.get("__l", s - 1)))
        return F.struct(title.alias("title"), stripped(F.array_join(F.slice("__l", s + 1, end - s - 1), "\n")).alias("body"))

    found = F.filter(F.transform("__s", section), lambda x: x["body"] != "")
    own = own.withColumn("__f", found).withColumn("__f", F.when(F.size("__f") > 1, F.col("__f")).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("title"), F.col(text).alias("body")))))
    own = unrolled(own, "*", items=F.col("__f"), place="section", item="__b").withColumn("title", F.col("__b.title"))
    body = F.col("__b.body")
    whole = F.col("title").isNotNull() & (13 * word_count(body) <= 10 * size)
    return packs(own, F.when(whole, F.array(unit(body))).otherwise(_paragraphs(body, size)), size, "\n\n", overlap).drop("__l", "__s", "__f", "__b")


def page_packs(docs: DataFrame, size: int, text: str = "text") -> DataFrame:
    """Pages, which form feeds end: with pages (their numbers), first_page and last_page; blank pages keep their number."""
    out = packs(docs.drop("pages", "first_page", "last_page"), units(F.split(text, "\f")), size, "\n\n").withColumn("pages", F.transform("labels", lambda x: x.cast("int")))
    return out.withColumns({"first_page": F.get("pages", F.lit(0)), "last_page": F.element_at("pages", -1)})


def slide_packs(docs: DataFrame, size: int, text: str = "text") -> DataFrame:
    """Slides, which lines of three hyphens part, with slide_count."""
    return packs(docs, units(F.split(text, r"(?m)^---[ \t]*$")), size, "\n\n").withColumn("slide_count", F.size("labels"))


def object_packs(docs: DataFrame, size: int, text: str = "text") -> DataFrame:
    """Entries of a JSON object as `key: value`, without blanks and line ends at their ends, with keys; texts that are none are packed by sentences, without keys."""
    entries = F.map_entries(F.from_json(text, "map<string,string>"))
    entry = lambda e: F.btrim(F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("null"))), F.lit(" \n"))
    own = F.filter(F.transform(entries, lambda e: unit(entry(e), label=e["key"])), lambda u: u["n"] > 0)
    return packs(docs, F.when(F.size(entries) > 0, own).otherwise(sentences(F.col(text), turns=True)), size, "\n", semantic=True).withColumn("keys", F.filter("labels", lambda x: x.isNotNull()))


def item_packs(docs: DataFrame, size: int, text: str = "text") -> DataFrame:
    """Items of a JSON array, with start_index and end_index; texts that are none are packed by lines."""
    items = F.from_json(text, "array<string>")
    is_array = stripped(F.col(text)).startswith("[") & (F.size(items) > 0)
    own = F.filter(F.transform(items, lambda x, i: unit(F.coalesce(x, F.lit("null")), label=i.cast("string"))), lambda u: u["n"] > 0)
    out = packs(docs, F.when(is_array, own).otherwise(units(F.split(text, "\n"))), size, "\n")
    at = lambda i: F.when(is_array, F.try_element_at("labels", F.lit(i)).cast("int"))
    return out.withColumns({"start_index": at(1), "end_index": at(-1)})


def row_packs(docs: DataFrame, size: int, text: str = "text") -> DataFrame:
    """Rows below the header, which counts against the size and stands on every chunk, with start_row and end_row (from 1).

    A lone line is a row without a header; blank lines are no rows.
    """
    lines = F.filter(F.transform(F.split(text, "\n"), stripped), lambda x: x != "")
    own = docs.withColumn("__l", lines).withColumn("__h", F.when(F.size("__l") > 1, F.get("__l", F.lit(0))))
    rows = units(F.when(F.col("__h").isNotNull(), F.slice("__l", 2, F.size("__l"))).otherwise(F.col("__l")))
    out = packs(own, rows, size, "\n", taken=F.coalesce(word_count(F.col("__h")), F.lit(0)))
    chunk = F.when(F.col("__h").isNotNull(), F.concat("__h", F.lit("\n"), "chunk")).otherwise(F.col("chunk"))
    return out.withColumns({"chunk": chunk, "start_row": F.col("first_unit") + 1, "end_row": F.col("last_unit") + 1, "has_header": F.col("__h").isNotNull()}).drop("__l", "__h")


def chapter_packs(docs: DataFrame, chapters: Column, size: int, overlap: int = 0) -> DataFrame:
    """Chapters (an array of title and text), with titles; one larger than a chunk is packed by itself, as sentences up to a topic."""
    own = lambda c: F.when(13 * word_count(c["text"]) > 10 * size, sentences(c["text"], bar=True, label=c["title"], turns=True)).otherwise(F.array(unit(stripped(c["text"]), label=c["title"])))
    kept = F.filter(F.flatten(F.transform(chapters, own)), lambda u: u["n"] > 0)
    return packs(docs, kept, size, "\n\n", overlap, semantic=True).withColumn("titles", F.col("labels"))

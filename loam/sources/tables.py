"""Loading documents of several formats, validation of requests, and table maintenance without MERGE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILE_TYPES = {"txt": "txt", "md": "md", "markdown": "md", "htm": "html", "html": "html", "json": "json", "csv": "csv", "pdf": "pdf", "docx": "docx"}


def words(text: str | Column) -> Column:
    """Whitespace-separated words."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def listing(memories: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of the table, newest first."""
    return memories.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Paragraphs, lines, characters and words of plain texts."""
    filled = lambda pattern: F.size(F.filter(F.split(text, pattern), lambda x: F.trim(x) != ""))
    return docs.withColumns({"paragraphs": filled(r"\n\n"), "lines": F.size(F.split(text, "\n")), "chars": F.length(text), "words": F.size(words(text))})


def markdown_headers(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per header: level and text."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(r"(?m)^(#{1,6})\s+(.+)$"), 1).alias("marks"), F.regexp_extract_all(text, F.lit(r"(?m)^(#{1,6})\s+(.+)$"), 2).alias("title"))
    return docs.select("*", F.posexplode(found).alias("header_no", "h")).select("*", F.length("h.marks").alias("level"), F.col("h.title").alias("title")).drop("h")


def html_fields(pages: DataFrame, html: str = "html") -> DataFrame:
    """Title, description and visible text of pages."""
    body = F.regexp_replace(html, r"(?is)<(script|style|title)[^>]*>.*?</\1>", " ")
    body = F.regexp_replace(F.regexp_replace(body, r"(?s)<!--.*?-->", " "), r"<[^>]+>", " ")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        body = F.replace(body, F.lit(entity), F.lit(plain))
    return pages.withColumns({
        "title": F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1),
        "description": F.regexp_extract(html, r"(?is)<meta\s+name=\"description\"\s+content=\"([^\"]*)\"", 1),
        "text": F.trim(F.regexp_replace(body, r"\s+", " ")),
    })


def json_units(docs: DataFrame, json: str, id_: str) -> DataFrame:
    """One unit per top-level key of a JSON object."""
    return docs.select(id_, F.explode(F.from_json(json, "map<string,string>")).alias("key", "value"))


def csv_units(rows: DataFrame) -> DataFrame:
    """Each row as 'header: value | header: value', and as JSON."""
    text = F.concat_ws(" | ", *[F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in rows.columns])
    return rows.withColumns({"row_text": text, "row_json": F.to_json(F.struct(*rows.columns))})


def file_type(name: str) -> Column:
    """Type by extension; null: not supported."""
    known = F.create_map(*[F.lit(x) for pair in FILE_TYPES.items() for x in pair])
    return F.try_element_at(known, F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1)))


def unrolled(df: DataFrame, *columns: str | Column, items: Column, place: str, item: str) -> DataFrame:
    """The columns with a row for each of the items and its place (from 0).

    The outer form, as behind the plain one Spark puts a filter on the size of the items, pushed down to the scan: what
    they are computed from is then written out in full wherever it is named, and computed again for each of these.
    """
    return df.select(*columns, F.posexplode_outer(items).alias(place, item)).where(F.col(place).isNotNull())


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks."""
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))


def request_rules() -> dict[str, Column]:
    return {
        "chunk_size": F.col("chunk_size").between(50, 4096),
        "chunk_overlap": F.col("chunk_overlap").between(0, 200),
        "file_name": F.length("file_name").between(1, 255),
        "file_type": F.col("file_type").isin("pdf", "docx", "pptx", "txt", "md", "html", "json", "csv", "epub"),
        "content": (F.col("source_type") != "base64") | F.col("content").isNotNull(),
    }


def batch_totals(docs: DataFrame, batch: str, ok: Column, chunks: Column) -> DataFrame:
    """Per batch: how many succeeded and failed, and their chunks; a bad document fails alone."""
    marked = docs.withColumns({"__ok": F.coalesce(ok, F.lit(False)), "__chunks": chunks})
    return marked.groupBy(batch).agg(F.count("*").alias("total"), F.count_if("__ok").alias("successful"), F.count_if(~F.col("__ok")).alias("failed"), F.coalesce(F.sum(F.when(F.col("__ok"), F.col("__chunks"))), F.lit(0)).alias("chunks"))


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row per key, the first in `order`."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def upserted(base: DataFrame, delta: DataFrame, key: str = "id", at: str = "updated_at") -> DataFrame:
    """The table after insert-or-replace: of each key the latest row; the delta wins ties."""
    both = base.withColumn("__new", F.lit(0)).unionByName(delta.withColumn("__new", F.lit(1)))
    return latest(both, key, F.desc(at), F.desc("__new")).drop("__new")


def updated(base: DataFrame, changes: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """Supplied fields replace stored ones and raise the version."""
    given = changes.select(key, *[F.col(f).alias(f"__{f}") for f in fields], F.lit(1).alias("__hit"))
    out = base.join(given, key, "left").withColumns({f: F.coalesce(f"__{f}", f) for f in fields} | {"version": F.col("version") + F.coalesce("__hit", F.lit(0))})
    return out.select(*base.columns)


def deleted(base: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return base.join(ids.select(key), key, "left_anti")


def changed(base: DataFrame, events: DataFrame, key: str = "id", at: str = "event_at") -> DataFrame:
    """The table after a feed of created, updated and deleted events; of each key the last event counts."""
    last = latest(events, key, F.desc(at))
    kept = base.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where("event <> 'deleted'").select(*base.columns))


def retained(df: DataFrame, as_of: Column, days: int, at: str = "ts", unless: Column | None = None) -> DataFrame:
    """Rows not older than `days`; older ones stay only where `unless` holds."""
    young = F.col(at) >= as_of - F.expr(f"make_interval(0, 0, 0, {days})")
    return df.where(young if unless is None else young | unless)

"""Queries over sources, maintenance and filters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import tables as T
from .registry import AS_OF, E, M, memories, metrics, query, table

NOW = f"TIMESTAMP '{AS_OF}'"
STAMP = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
DSTAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"
WORDS = r"list_filter(string_split_regex({0}, '[ \t\n\x0B\f\r]+'), lambda w : w <> '')"


@query(f"WITH {M} SELECT id, md5(content) AS content_hash, {DSTAMP.format('created_at')}, status FROM m ORDER BY m.created_at DESC, id LIMIT 100 OFFSET 20")
def load_memories(spark, sf_dir):
    return T.listing(memories(spark, sf_dir), 100, 20).select("id", F.md5("content").alias("content_hash"), STAMP("created_at"), "status")


@query(rf"""SELECT doc_id, len(list_filter(string_split(text, chr(10) || chr(10)), lambda x : trim(x) <> '')) AS paragraphs, len(string_split(text, chr(10))) AS lines,
  length(text) AS chars, len({WORDS.format("text")}) AS words FROM documents""")
def load_text_documents(spark, sf_dir):
    return T.text_counts(table(spark, sf_dir, "documents")).select("doc_id", "paragraphs", "lines", "chars", "words")


@query(r"""SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title,
  regexp_extract(html, '(?is)<meta\s+name="description"\s+content="([^"]*)"', 1) AS description, length(html) AS html_chars FROM pages""")
def load_html_documents(spark, sf_dir):
    return T.html_fields(table(spark, sf_dir, "pages")).select("page_id", "title", "description", F.length("html").alias("html_chars"))


@query()
def html_text(spark, sf_dir):
    return T.html_fields(table(spark, sf_dir, "pages")).select("page_id", "text")


@query("SELECT event_id, k AS key, json_extract_string(props, k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def load_json_documents(spark, sf_dir):
    return T.json_units(table(spark, sf_dir, "events"), "props", "event_id")


@query("""SELECT c_custkey, 'c_custkey: ' || c_custkey || ' | c_name: ' || c_name || ' | c_nationkey: ' || c_nationkey || ' | c_acctbal: ' || c_acctbal || ' | c_mktsegment: ' || c_mktsegment AS row_text FROM customer""")
def load_csv_documents(spark, sf_dir):
    return T.csv_units(table(spark, sf_dir, "customer")).select("c_custkey", "row_text")


@query(r"""SELECT page_id, CASE lower(regexp_extract(url, '\.([A-Za-z0-9]+)(?:[?#].*)?$', 1)) WHEN 'txt' THEN 'txt' WHEN 'md' THEN 'md' WHEN 'markdown' THEN 'md' WHEN 'htm' THEN 'html'
  WHEN 'html' THEN 'html' WHEN 'json' THEN 'json' WHEN 'csv' THEN 'csv' WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' END AS file_type FROM pages""")
def infer_file_type(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.file_type("url").alias("file_type"))


@query("""SELECT doc_id % 100 AS batch, count(*) AS total, count(*) FILTER (length(text) >= 400) AS successful, count(*) FILTER (length(text) < 400) AS failed,
  CAST(coalesce(sum(ceil(length(text) / 1000.0)) FILTER (length(text) >= 400), 0) AS BIGINT) AS chunks FROM documents GROUP BY 1""")
def ingest_batch(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("batch", F.expr("doc_id % 100"))
    return T.batch_totals(docs, "batch", F.length("text") >= 400, F.ceil(F.length("text") / 1000))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id * 13 % 5000 NOT BETWEEN 50 AND 4096 THEN 'chunk_size' END, CASE WHEN doc_id % 250 NOT BETWEEN 0 AND 200 THEN 'chunk_overlap' END,
  CASE WHEN doc_id % 9 = 0 THEN 'file_name' END, CASE WHEN doc_id % 4 = 3 THEN 'file_type' END, CASE WHEN doc_id % 2 = 0 AND doc_id % 10 = 0 THEN 'content' END], lambda x : x IS NOT NULL), ',') AS broken FROM documents""")
def validate_ingest_requests(spark, sf_dir):
    requests = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "doc_id * 13 % 5000 AS chunk_size", "doc_id % 250 AS chunk_overlap", "if(doc_id % 9 = 0, '', concat('f', doc_id)) AS file_name",
        "element_at(array('txt', 'md', 'html', 'exe'), cast(doc_id % 4 + 1 as int)) AS file_type", "if(doc_id % 2 = 0, 'base64', 'file') AS source_type", "if(doc_id % 10 = 0, null, text) AS content",
    )
    return requests.select("doc_id", F.array_join(T.violations(T.request_rules()), ",").alias("broken"))


@query(f"""WITH {M}, d AS (SELECT * REPLACE (content || '!' AS content, updated_at + to_hours(10) AS updated_at) FROM m WHERE id % 3 = 0
  UNION ALL SELECT * REPLACE (id + 1000000 AS id) FROM m WHERE id % 10 = 0),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, new DESC) AS n FROM (SELECT *, 0 AS new FROM m UNION ALL SELECT *, 1 FROM d))
SELECT id, md5(content) AS content_hash, {DSTAMP.format("updated_at")} FROM b WHERE n = 1""")
def upsert_memories(spark, sf_dir):
    base = memories(spark, sf_dir)
    changes = base.where("id % 3 = 0").withColumns({"content": F.concat("content", F.lit("!")), "updated_at": F.expr("updated_at + interval 10 hours")})
    added = base.where("id % 10 = 0").withColumn("id", F.col("id") + 1000000)
    return T.upserted(base, changes.unionByName(added)).select("id", F.md5("content").alias("content_hash"), STAMP("updated_at"))


@query(f"""WITH {M} SELECT id, md5(CASE WHEN id % 4 = 0 THEN 'new ' || id ELSE content END) AS content_hash, CASE WHEN id % 4 = 0 AND id % 8 = 0 THEN '{{}}' ELSE metadata END AS metadata,
  CAST(version + CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END AS INTEGER) AS version FROM m""")
def update_memory_versioned(spark, sf_dir):
    base = memories(spark, sf_dir)
    changes = base.where("id % 4 = 0").selectExpr("id", "concat('new ', id) AS content", "if(id % 8 = 0, '{}', null) AS metadata")
    return T.updated(base, changes, ["content", "metadata"]).select("id", F.md5("content").alias("content_hash"), "metadata", "version")


@query(f"WITH {M} SELECT id, agent_id FROM m WHERE id % 5 <> 0")
def delete_memories(spark, sf_dir):
    base = memories(spark, sf_dir)
    return T.deleted(base, base.where("id % 5 = 0")).select("id", "agent_id")


@query(f"WITH {M} SELECT id, {DSTAMP.format('expires_at')} FROM m WHERE m.expires_at IS NULL OR m.expires_at >= TIMESTAMP '2024-01-20'")
def purge_expired(spark, sf_dir):
    return memories(spark, sf_dir).where("expires_at is null or expires_at >= timestamp'2024-01-20'").select("id", STAMP("expires_at"))


@query(f"WITH {E} SELECT operation, count(*) AS kept FROM e WHERE ts >= {NOW} - INTERVAL 10 DAY OR operation = 'purchase' GROUP BY 1")
def apply_retention(spark, sf_dir):
    kept = T.retained(metrics(spark, sf_dir), F.lit(AS_OF).cast("timestamp"), 10, unless=F.col("operation") == "purchase")
    return kept.groupBy("operation").agg(F.count("*").alias("kept"))


@query(f"WITH {E} SELECT event_id, '{{\"operation\":\"' || operation || '\",\"agent_id\":' || agent_id || '}}' AS line FROM e WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06'")
def export_analytics(spark, sf_dir):
    rows = metrics(spark, sf_dir).where("ts between timestamp'2024-01-05' and timestamp'2024-01-06'")
    return rows.select("event_id", F.to_json(F.struct("operation", "agent_id")).alias("line"))


@query("SELECT label, bool_and(len(embedding) = 64) AS valid, count(*) AS n FROM embeddings GROUP BY 1")
def validate_embedding_dims(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.bool_and(F.size("embedding") == 64).alias("valid"), F.count("*").alias("n"))


@query(f"""WITH {M} SELECT id, CASE WHEN id % 6 = 1 THEN 'changed' ELSE status END AS status FROM m WHERE id % 6 <> 0
UNION ALL SELECT id + 2000000, 'created' FROM m WHERE id % 6 = 2""")
def apply_change_events(spark, sf_dir):
    base = memories(spark, sf_dir).select("id", "status", "updated_at")
    own = base.withColumnRenamed("updated_at", "event_at")
    kinds = [("id % 6 = 0 or id % 6 = 1", "id", "'changed'", "'updated'", 0), ("id % 6 = 0", "id", "status", "'deleted'", 1), ("id % 6 = 2", "id + 2000000", "'created'", "'created'", 0)]
    events = None
    for where, key, status, event, hours in kinds:
        part = own.where(where).selectExpr(f"{key} AS id", f"{status} AS status", f"event_at + make_interval(0, 0, 0, 0, {hours}) AS event_at", f"{event} AS event")
        events = part if events is None else events.unionByName(part)
    return T.changed(base.select("id", "status"), events)


@query(f"WITH {M} SELECT id FROM m WHERE agent_id = 'src3' AND status = 'active' AND json_extract_string(metadata, '$.lang') = 'en'")
def filter_memories(spark, sf_dir):
    return memories(spark, sf_dir).where("agent_id = 'src3' and status = 'active' and get_json_object(metadata, '$.lang') = 'en'").select("id")


@query(f"WITH {M} SELECT id, agent_id, CAST(row_number() OVER (ORDER BY updated_at DESC, id) AS INTEGER) AS place FROM m ORDER BY place LIMIT 50")
def sort_results(spark, sf_dir):
    top = memories(spark, sf_dir).orderBy(F.desc("updated_at"), "id").limit(50)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("updated_at"), "id"))).select("id", "agent_id", "place")  # over 50 rows


@query(f"WITH {M}, c AS (SELECT count(*) AS total FROM m), p AS (SELECT id FROM m ORDER BY created_at, id LIMIT 20 OFFSET 40) SELECT id, total, 60 < total AS has_more FROM p, c")
def paginate(spark, sf_dir):
    base = memories(spark, sf_dir)
    page = base.orderBy("created_at", "id").offset(40).limit(20).select("id")
    return page.crossJoin(F.broadcast(base.agg(F.count("*").alias("total")))).withColumn("has_more", F.col("total") > 60)  # one row


@query(f"WITH {E} SELECT event_id, operation FROM e WHERE ts BETWEEN {NOW} - INTERVAL 7 DAY AND {NOW}")
def filter_time_range(spark, sf_dir):
    return metrics(spark, sf_dir).where(f"ts between timestamp'{AS_OF}' - interval 7 days and timestamp'{AS_OF}'").select("event_id", "operation")


@query("SELECT conv_id, turn, regexp_matches(lower(text), 'the |and |que ') AS flagged FROM conversations")
def detect_keywords(spark, sf_dir):
    found = F.exists(F.array(*map(F.lit, ("the ", "and ", "que "))), lambda k: F.contains(F.lower("text"), k))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", found.alias("flagged"))


@query(f"WITH {E} SELECT event_id, operation FROM e WHERE operation = 'error' AND ts >= TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id LIMIT 100")
def search_logs(spark, sf_dir):
    return metrics(spark, sf_dir).where("operation = 'error' and ts >= timestamp'2024-01-10'").orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "operation")


@query(f"WITH {M} SELECT id FROM m WHERE created_at <= TIMESTAMP '2024-01-15' AND (expires_at IS NULL OR expires_at >= TIMESTAMP '2024-01-15')")
def filter_current_facts(spark, sf_dir):
    return memories(spark, sf_dir).where("(created_at is null or created_at <= timestamp'2024-01-15') and (expires_at is null or expires_at >= timestamp'2024-01-15')").select("id")


@query(f"WITH {M} SELECT agent_id, status, count(*) AS n FROM m GROUP BY ALL")
def count_memories(spark, sf_dir):
    return memories(spark, sf_dir).groupBy("agent_id", "status").agg(F.count("*").alias("n"))

"""Streaming queries over a directory of event files; each run takes all files that are there."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..operators import ingestion as I
from ..operators.metrics import r6
from ..sources.scratch import folder
from ..sources.scratch import Scratch
from ..streaming import state as Y
from ..streaming import streams as S
from .registry import E, M, memories, query, table
from .texts import KIND, MENTIONS


def stream(spark, sf_dir):
    """events as a stream of (ts, event_id, operation, agent_id, value)."""
    path = f"{sf_dir}/events.parquet"
    raw = S.events(spark, f"{sf_dir}/event[s].parquet", spark.read.parquet(path).schema, 100)  # a pattern: the path can be one file
    return raw.select(F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("operation"), F.col("user_id").alias("agent_id"), "value")


def finished(spark, df, mode):
    return S.run_once(df, os.path.join(folder(spark), "stream_" + uuid.uuid4().hex), mode)


@query(f"WITH {E} SELECT operation, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(avg(value), 6) AS mean FROM e GROUP BY operation, time_bucket(INTERVAL 1 HOUR, ts)")
def stream_rollup(spark, sf_dir):
    out = finished(spark, S.rollup(stream(spark, sf_dir), "operation", late=S.HISTORY), "complete")
    return out.select("operation", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", r6("mean").alias("mean"))


FORMAT = "yyyy-MM-dd HH:mm:ss"


@query("""WITH b AS (SELECT user_id AS agent_id, value, time_bucket(INTERVAL 3 HOUR, ts) AS t0 FROM events), w AS (SELECT agent_id, value, t0 AS start FROM b UNION ALL SELECT agent_id, value, t0 - INTERVAL 3 HOUR FROM b)
SELECT agent_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(avg(value), 6) AS mean FROM w GROUP BY agent_id, w.start""")
def stream_sliding_rate(spark, sf_dir):
    out = finished(spark, S.rollup(stream(spark, sf_dir), "agent_id", every="6 hours", slide="3 hours", late=S.HISTORY), "complete")
    return out.select("agent_id", F.date_format("start", FORMAT).alias("start"), "n", r6("mean").alias("mean"))


@query("""WITH o AS (SELECT user_id AS agent_id, ts, coalesce(ts > lag(ts) OVER w + INTERVAL 600 MINUTE, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT agent_id, ts, sum(new::INT) OVER (PARTITION BY agent_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o)
SELECT agent_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY agent_id, s""")
def stream_sessions(spark, sf_dir):
    out = finished(spark, S.sessions(stream(spark, sf_dir), "agent_id", "600 minutes", late=S.HISTORY), "complete")
    return out.select("agent_id", F.date_format("start", FORMAT).alias("start"), "n")


def arriving(spark, sf_dir):
    """documents as a stream of new files."""
    path = f"{sf_dir}/documents.parquet"
    return S.events(spark, f"{sf_dir}/document[s].parquet", spark.read.parquet(path).schema, 100)


CHANGE = "named_struct('id', {0}, 'status', '{1}', 'event', '{2}', 'event_at', {3})"
UPDATED = CHANGE.format("doc_id", "changed", "updated", "at")
DELETED = CHANGE.format("doc_id", "gone", "deleted", "at + interval 1 hour")
CREATED = CHANGE.format("doc_id + 2000000", "created", "created", "at")
CHANGES = f"inline(case doc_id % 6 when 0 then array({UPDATED}, {DELETED}) when 1 then array({UPDATED}) when 2 then array({CREATED}) end)"


@query(f"""WITH {M} SELECT id, CASE WHEN id % 6 = 1 THEN 'changed' ELSE status END AS status FROM m WHERE id % 6 <> 0
UNION ALL SELECT id + 2000000, 'created' FROM m WHERE id % 6 = 2""")
def stream_cdc_apply(spark, sf_dir):
    """The memory table after a stream of changes to its documents."""
    at = "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(doc_id % 720 as int)) as at"
    changes = arriving(spark, sf_dir).selectExpr("doc_id", at).selectExpr(CHANGES)
    table_of = Y.ChangeTable(spark, os.path.join(folder(spark), "changes_" + uuid.uuid4().hex), "id bigint, status string")
    table_of.run(changes)
    return table_of.table(memories(spark, sf_dir).select("id", "status"))


def incoming(docs):
    return docs.select(F.col("doc_id").alias("id"), "text", F.expr(KIND).alias("file_type"), F.expr("concat('f', doc_id)").alias("file_name"))


@query(f"""WITH {MENTIONS}, ec AS (SELECT doc_id, count(*) AS entities FROM n GROUP BY 1) SELECT d.doc_id AS memory_id, coalesce(entities, 0) AS entities, greatest(coalesce(entities, 0) - 1, 0) AS relationships,
length(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', '', 'g')) > 0 AS success FROM documents d LEFT JOIN ec ON ec.doc_id = d.doc_id""")
def ingest_documents(spark, sf_dir):
    """Everything that ingestion stores, counted; tests tie the counts of chunks and vectors to the single operators."""
    out = ingested(spark, sf_dir)
    return out.select("memory_id", "entities", "relationships", "success")


def ingested(spark, sf_dir):
    docs = incoming(table(spark, sf_dir, "documents"))
    chunks = Scratch(spark).write(I.enriched_chunks(docs), "chunks")
    return I.stored_documents(docs, chunks, *I.entities_of(docs))


@query()
def ingest_quality(spark, sf_dir):
    """Chunks, tokens, vectors and quality that ingestion stores of each document."""
    return ingested(spark, sf_dir).select("memory_id", "chunks", "tokens", "vectors", "confidence", "risk", "flags")


@query()  # tests hold it against the batch
def stream_ingest_documents(spark, sf_dir):
    """Chunks of documents as they arrive, enriched and stored."""
    out = finished(spark, I.enriched_chunks(incoming(arriving(spark, sf_dir))), "append")
    return out.select("memory_id", "chunk_id", "chunk_no", F.md5("chunk").alias("chunk"), "context", "confidence", "risk", "tokens")

"""Registration of queries, and the frames that they read, in Spark and in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF = "2024-02-01 00:00:00"


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as the memory table."""
    created = F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(doc_id % 720 as int))")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("agent_id"), F.expr("concat('s', doc_id % 50)").alias("session_id"),
        created.alias("created_at"), (created + F.expr("make_interval(0, 0, 0, 0, cast(doc_id % 5 as int))")).alias("updated_at"),
        F.expr("""concat('{"lang":"', lang, '","source":"', source, '"}')""").alias("metadata"), F.expr("if(doc_id % 11 = 0, 'archived', 'active')").alias("status"),
        F.lit(1).alias("version"), F.when(F.expr("doc_id % 7 = 0"), created + F.expr("make_interval(0, 0, 0, 0, 240)")).alias("expires_at"),
    )


M = """m AS (SELECT doc_id AS id, text AS content, source AS agent_id, 's' || (doc_id % 50) AS session_id,
  TIMESTAMP '2024-01-01' + to_hours(doc_id % 720) AS created_at, TIMESTAMP '2024-01-01' + to_hours(doc_id % 720 + doc_id % 5) AS updated_at,
  '{"lang":"' || lang || '","source":"' || source || '"}' AS metadata, CASE WHEN doc_id % 11 = 0 THEN 'archived' ELSE 'active' END AS status,
  1 AS version, CASE WHEN doc_id % 7 = 0 THEN TIMESTAMP '2024-01-01' + to_hours(doc_id % 720 + 240) END AS expires_at FROM documents)"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access and quality figures of each memory."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("agent_id"), F.expr("doc_id * 3 % 20").alias("access_count"), F.expr("doc_id * 7 % 90").alias("days_since_access"),
        F.expr("doc_id * 37 % 100 / 100D").alias("confidence_score"), F.expr("doc_id * 53 % 100 / 100D").alias("hallucination_score"), F.length("text").alias("n_chars"),
    )


UL = """u AS (SELECT doc_id AS id, source AS agent_id, doc_id * 3 % 20 AS access_count, doc_id * 7 % 90 AS days_since_access,
  (doc_id * 37 % 100) / 100.0::DOUBLE AS confidence_score, (doc_id * 53 % 100) / 100.0::DOUBLE AS hallucination_score, length(text) AS n_chars FROM documents)"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as the metric stream."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("operation"), F.expr("element_at(array('latency', 'throughput', 'error_rate'), cast(user_id % 3 + 1 as int))").alias("metric_type"),
        "value", F.col("user_id").alias("agent_id"), F.expr("event_type <> 'error'").alias("success"), F.expr("concat('m', user_id % 2)").alias("model_used"),
        F.expr("element_at(array('l1', 'l2', 'embedding', 'rerank', 'hallucination'), cast(user_id % 5 + 1 as int))").alias("cache_type"), F.expr("value > 25").alias("hit"),
    )


E = """e AS (SELECT event_id, ts, event_type AS operation, (['latency', 'throughput', 'error_rate'])[user_id % 3 + 1] AS metric_type, value, user_id AS agent_id,
  event_type <> 'error' AS success, 'm' || (user_id % 2) AS model_used, (['l1', 'l2', 'embedding', 'rerank', 'hallucination'])[user_id % 5 + 1] AS cache_type, value > 25 AS hit FROM events)"""


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as the usage log of prompt templates."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.expr("user_id % 10").alias("template_id"), F.expr("event_type <> 'error'").alias("success"),
        F.expr("least(value / 100, 1D)").alias("confidence"), F.expr("value * 10").alias("latency_ms"),
        F.expr("if(event_type = 'error', element_at(array('timeout', 'hallucination', 'parsing', 'format', 'confidence'), cast(event_id % 5 + 1 as int)), null)").alias("error_message"),
    )


P = """p AS (SELECT event_id, ts, user_id % 10 AS template_id, event_type <> 'error' AS success, least(value / 100, 1.0::DOUBLE) AS confidence, value * 10 AS latency_ms,
  CASE WHEN event_type = 'error' THEN (['timeout', 'hallucination', 'parsing', 'format', 'confidence'])[event_id % 5 + 1] END AS error_message FROM events)"""

"""Health, staleness and cleanup of memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def score() -> Column:
    """0.3 freshness + 0.3 use + 0.3 confidence + 0.1 soundness."""
    fresh = 1 - F.least(F.col("days_since_access") / 30.0, F.lit(1.0))
    return 0.3 * fresh + 0.3 * F.least(F.col("access_count") / 10.0, F.lit(1.0)) + 0.3 * F.col("confidence_score") + 0.1 * (1 - F.col("hallucination_score"))


def memory_health(usage: DataFrame) -> DataFrame:
    s = F.col("score")
    status = F.when(s >= 0.8, "excellent").when(s >= 0.6, "good").when(s >= 0.4, "fair").when(s >= 0.2, "poor").otherwise("critical")
    return usage.withColumn("score", score()).withColumn("status", status)


def stale(usage: DataFrame, days: int, accesses: int) -> DataFrame:
    value = F.least(F.lit(1.0), F.col("days_since_access") / 90.0) * 0.7 + (1 - F.least(F.col("access_count") / float(accesses), F.lit(1.0))) * 0.3
    old = usage.where((F.col("days_since_access") > days) & (F.col("access_count") < accesses)).withColumn("staleness", value)
    return old.withColumn("action", F.when(F.col("staleness") > 0.9, "delete").when(F.col("staleness") > 0.7, "archive").otherwise("monitor"))


def doubtful(usage: DataFrame, least: float) -> DataFrame:
    low, high = F.col("confidence_score") < least, F.col("hallucination_score") > round(1 - least, 6)
    return usage.where(low | high).withColumns({"issues": low.cast("int") + high.cast("int"), "action": F.when(F.col("confidence_score") < 0.4, "delete").otherwise("review")})


def cleanup_plan(usage: DataFrame, hashes: DataFrame) -> DataFrame:
    """(id, action, reason): stale rows, doubtful ones, and copies behind the first of each content."""
    old = stale(usage, 30, 5).where("staleness > 0.8").select("id", F.when(F.col("staleness") > 0.9, "delete").otherwise("archive").alias("action"), F.lit("stale").alias("reason"))
    weak = usage.where("confidence_score < 0.4").select("id", F.lit("delete").alias("action"), F.lit("low_confidence").alias("reason"))
    copies = hashes.withColumn("i", F.row_number().over(Window.partitionBy("h").orderBy("id"))).where("i > 1").select("id", F.lit("merge").alias("action"), F.lit("duplicate").alias("reason"))
    return old.unionByName(weak).unionByName(copies)


def cleaned(memories: DataFrame, plan: DataFrame) -> DataFrame:
    """The table after a plan: deleted and merged rows go, archived ones are marked."""
    gone, shelved = plan.where("action in ('delete', 'merge')").select("id").distinct(), plan.where("action = 'archive'").select("id").distinct()
    left = memories.join(gone, "id", "left_anti").join(shelved.withColumn("__shelved", F.lit(True)), "id", "left")
    return left.withColumn("status", F.when(F.col("__shelved"), "archived").otherwise(F.col("status"))).drop("__shelved")


def versions(facts: DataFrame, most: int, *keys: str) -> DataFrame:
    """The newest versions of each key: number, whether current, and when the next one replaced it."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("created_at"), F.desc("id"))
    own = facts.withColumns({"n": F.row_number().over(newest), "valid_to": F.lag("created_at").over(newest)})
    return own.where(F.col("n") <= most).withColumn("current", F.col("n") == 1)


def status_checks(samples: DataFrame, warning: float, critical: float) -> DataFrame:
    """Status of every sample, and the worst of all."""
    grade = F.when(F.col("value") >= critical, 2).when(F.col("value") >= warning, 1).otherwise(0)
    named = lambda c: F.element_at(F.array(F.lit("healthy"), F.lit("warning"), F.lit("critical")), c + 1)
    own = samples.withColumn("__g", grade)
    worst = own.agg(F.max("__g").alias("__w"))
    return own.crossJoin(F.broadcast(worst)).select("operation", named(F.col("__g")).alias("status"), named(F.col("__w")).alias("overall"))  # one row

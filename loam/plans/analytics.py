"""Queries over metrics, experiments, prompts, conversations and memory quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import experiments as X
from ..operators import metrics as Q
from ..operators import quality as H
from .base import DSTAMP, WORDS
from .registry import AS_OF, UL, E, M, P, memories, metrics, prompts, query, table, usage

NOW = f"TIMESTAMP '{AS_OF}'"
STATS = "count(value) AS n, round(sum(value), 6) AS total, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, " + ", ".join(f"round(quantile_cont(value, {p}), 6) AS p{round(p * 100)}" for p in Q.POINTS)


@query(f"WITH {E} SELECT metric_type, {STATS} FROM e WHERE ts BETWEEN {NOW} - INTERVAL 20 DAY AND {NOW} GROUP BY 1")
def metric_aggregate(spark, sf_dir):
    return Q.summary(Q.trailing(metrics(spark, sf_dir), AS_OF, "20 days"), "metric_type")


@query(f"WITH {E} SELECT operation, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.75), 6) AS p75 FROM e GROUP BY 1")
def metric_percentiles(spark, sf_dir):
    at = F.percentile("value", F.array(F.lit(0.1), F.lit(0.25), F.lit(0.75)))
    return metrics(spark, sf_dir).groupBy("operation").agg(at.alias("p")).select("operation", *[Q.r6(F.col("p")[i]).alias(n) for i, n in enumerate(("p10", "p25", "p75"))])


@query(f"WITH {E} SELECT operation, metric_type, model_used, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, {STATS} FROM e GROUP BY 1, 2, 3, date_trunc('hour', ts)")
def hourly_rollup(spark, sf_dir):
    out = Q.summary(metrics(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "ts")), "operation", "metric_type", "model_used", "hour")
    return out.withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm:ss"))


@query(f"WITH {E} SELECT operation, metric_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, {STATS} FROM e GROUP BY 1, 2, date_trunc('day', ts)")
def daily_rollup(spark, sf_dir):
    return Q.summary(metrics(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "operation", "metric_type", "day")


@query(f"""WITH {E}, s AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-05', INTERVAL 1 HOUR)) AS step),
g AS (SELECT date_trunc('hour', ts) AS step, count(value) AS n, round(avg(value), 6) AS mean FROM e WHERE operation = 'click' GROUP BY 1)
SELECT strftime(s.step, '%Y-%m-%d %H:%M:%S') AS step, coalesce(n, 0) AS n, mean FROM s LEFT JOIN g ON g.step = s.step""")
def metric_series(spark, sf_dir):
    out = Q.series(metrics(spark, sf_dir).where("operation = 'click'"), "hour", "2024-01-01 00:00:00", "2024-02-05 00:00:00")
    return out.withColumn("step", F.date_format("step", "yyyy-MM-dd HH:mm:ss"))


@query(f"WITH {E} SELECT metric_type, operation, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, round(stddev_samp(value), 6) AS std, arg_max(value, event_id) AS last FROM e WHERE ts >= TIMESTAMP '2024-01-30' GROUP BY ALL")
def recent_performance(spark, sf_dir):
    own = metrics(spark, sf_dir).where("ts >= timestamp'2024-01-30'").groupBy("metric_type", "operation")
    return own.agg(F.count("*").alias("n"), Q.r6(F.avg("value")).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), Q.r6(F.stddev_samp("value")).alias("std"), F.max_by("value", "event_id").alias("last"))


@query(f"WITH {E} SELECT metric_type, count(*) AS events, round(count(*) / 48.0, 6) AS per_hour, count(DISTINCT operation) AS operations, round(median(value), 6) AS middle, round(coalesce(stddev_samp(value), 0), 6) AS std FROM e WHERE ts BETWEEN {NOW} - INTERVAL 96 HOUR AND {NOW} GROUP BY 1")
def performance_summary(spark, sf_dir):
    own = Q.trailing(metrics(spark, sf_dir), AS_OF, "96 hours").groupBy("metric_type")
    return own.agg(F.count("*").alias("events"), Q.r6(F.count("*") / 48.0).alias("per_hour"), F.count_distinct("operation").alias("operations"), Q.r6(F.median("value")).alias("middle"), Q.r6(F.coalesce(F.stddev_samp("value"), F.lit(0.0))).alias("std"))


BASE = f"{E}, k AS (SELECT *, row_number() OVER (PARTITION BY metric_type, operation ORDER BY ts DESC, event_id DESC) AS j FROM e), b AS (SELECT metric_type, operation, {STATS} FROM k WHERE j <= 500 GROUP BY ALL HAVING count(value) >= 100)"


def base(spark, sf_dir):
    return Q.baselines(metrics(spark, sf_dir), 500)


@query(f"WITH {BASE} SELECT * FROM b")
def compute_baselines(spark, sf_dir):
    return base(spark, sf_dir)


@query(f"""WITH {E}, k AS (SELECT *, row_number() OVER (PARTITION BY operation ORDER BY ts DESC, event_id DESC) AS j FROM e), l AS (SELECT *, row_number() OVER (PARTITION BY operation ORDER BY ts, event_id) - 1 AS i FROM k WHERE j <= 50)
SELECT operation, count(*) AS n, round(regr_slope(value, i), 6) AS slope, round(coalesce(regr_r2(value, i), 0), 6) AS r2, CASE WHEN regr_slope(value, i) > 0 THEN 'increasing' WHEN regr_slope(value, i) < 0 THEN 'decreasing' ELSE 'stable' END AS direction FROM l GROUP BY 1 HAVING count(*) >= 10""")
def detect_trends(spark, sf_dir):
    return Q.trends(metrics(spark, sf_dir))


JOINED = f"""{BASE}, a AS (SELECT e.*, abs(value - mean) / nullif(std, 0) AS sigmas, CASE WHEN value <= p50 THEN 50 * value / nullif(p50, 0) WHEN value <= p95 THEN 50 + 45 * (value - p50) / nullif(p95 - p50, 0)
  WHEN value <= p99 THEN 95 + 4 * (value - p95) / nullif(p99 - p95, 0) ELSE 99.5 END AS rank FROM e JOIN b USING (metric_type, operation))"""


@query(f"WITH {JOINED} SELECT event_id, round(sigmas, 6) AS sigmas FROM a WHERE sigmas > 2")
def detect_anomalies(spark, sf_dir):
    return Q.against(metrics(spark, sf_dir), base(spark, sf_dir)).where("sigmas > 2").select("event_id", Q.r6("sigmas").alias("sigmas"))


@query(f"WITH {JOINED} SELECT event_id, round(rank, 6) AS rank FROM a")
def percentile_rank(spark, sf_dir):
    return Q.against(metrics(spark, sf_dir), base(spark, sf_dir)).select("event_id", Q.r6("rank").alias("rank"))


@query(f"WITH {JOINED} SELECT metric_type, operation, CASE WHEN coalesce(sigmas, 0) > 4 OR rank > 99.5 THEN 'critical' WHEN coalesce(sigmas, 0) > 3 OR rank > 95 THEN 'warning' ELSE 'info' END AS severity, count(*) AS n FROM a GROUP BY ALL")
def anomaly_severity(spark, sf_dir):
    return Q.against(metrics(spark, sf_dir), base(spark, sf_dir)).withColumn("severity", Q.severity()).groupBy("metric_type", "operation", "severity").agg(F.count("*").alias("n"))


@query(f"""WITH {E}, o AS (SELECT date_trunc('hour', ts) AS w, metric_type, value, row_number() OVER (PARTITION BY date_trunc('hour', ts), metric_type ORDER BY ts, event_id) AS i FROM e)
SELECT strftime(x.w, '%Y-%m-%d %H:%M:%S') AS w, x.metric_type AS m1, y.metric_type AS m2, count(*) AS n, round(corr(x.value, y.value), 6) AS r FROM o x JOIN o y ON x.w = y.w AND x.i = y.i AND x.metric_type < y.metric_type
GROUP BY x.w, m1, m2 HAVING count(*) >= 4 AND abs(corr(x.value, y.value)) > 0.8""")
def metric_correlations(spark, sf_dir):
    return Q.correlations(metrics(spark, sf_dir), least=4).withColumn("w", F.date_format("w", "yyyy-MM-dd HH:mm:ss"))


_ADVICE = "a(kind, metric, other, direction, advice) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in Q.ADVICE) + ")"


@query(f"""WITH {E}, k AS (SELECT *, row_number() OVER (PARTITION BY operation ORDER BY ts DESC, event_id DESC) AS j FROM e), l AS (SELECT *, row_number() OVER (PARTITION BY operation, metric_type ORDER BY ts, event_id) - 1 AS i FROM k WHERE j <= 50),
t AS (SELECT operation, metric_type, regr_slope(value, i) AS slope, regr_r2(value, i) AS r2, min(ts) AS a, max(ts) AS z FROM l GROUP BY 1, 2 HAVING count(*) >= 10 AND regr_r2(value, i) >= 0.05 AND regr_slope(value, i) <> 0),
o AS (SELECT time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') AS w, metric_type, value, row_number() OVER (PARTITION BY time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01'), metric_type ORDER BY ts, event_id) AS i FROM e),
c AS (SELECT x.w, x.metric_type AS m1, y.metric_type AS m2, corr(x.value, y.value) AS r FROM o x JOIN o y ON x.w = y.w AND x.i = y.i AND x.metric_type < y.metric_type WHERE x.w IN (SELECT w FROM o GROUP BY 1 HAVING count(*) >= 10) GROUP BY 1, 2, 3 HAVING count(*) >= 5 AND abs(corr(x.value, y.value)) > 0.8),
m AS (SELECT m1, m2, count(*) AS seen, arg_min(r, w) AS r, min(w) AS a, max(w) AS z FROM c GROUP BY 1, 2),
p AS (SELECT 'trend' AS kind, concat_ws('_', 'trend', operation, metric_type, d) AS pattern, metric_type AS metric, NULL AS other, d AS direction, r2 AS confidence, abs(slope) AS impact, 1 AS seen, a, z FROM (SELECT *, CASE WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS d FROM t)
  UNION ALL SELECT 'correlation', concat_ws('_', 'correlation', m1, m2), m1, m2, CASE WHEN r > 0 THEN 'increasing' ELSE 'decreasing' END, least(1.0::DOUBLE, 0.6::DOUBLE + 0.1::DOUBLE * seen), abs(r), seen, a, z FROM m),
{_ADVICE}
SELECT CAST(row_number() OVER (ORDER BY round(impact * confidence, 9) DESC, pattern) AS INTEGER) AS rank, pattern, p.direction, round(confidence, 6) AS confidence, round(impact, 6) AS impact, seen, strftime(p.a, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(p.z, '%Y-%m-%d %H:%M:%S') AS last_seen, coalesce(advice, '') AS advice
FROM p LEFT JOIN a ON a.kind = p.kind AND a.metric = p.metric AND a.other IS NOT DISTINCT FROM p.other AND a.direction = p.direction WHERE round(confidence, 9) >= 0.05""")
def rank_patterns(spark, sf_dir):
    """With a low bound on fit and confidence, as the events are independent of each other."""
    at = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_seen", "last_seen")]
    return Q.patterns(metrics(spark, sf_dir), 0.05, "2 hours", 0.05).select("rank", "pattern", "direction", Q.r6("confidence").alias("confidence"), Q.r6("impact").alias("impact"), "seen", *at, "advice")


@query(f"WITH {E} SELECT count(*) AS events, round(avg(value), 6) AS mean, round(count(*) FILTER (success) / count(*)::DOUBLE, 6) AS success_rate, round(count(*) FILTER (hit) / count(*)::DOUBLE, 6) AS hit_rate, count(*) FILTER (NOT success) AS errors, count(DISTINCT agent_id) AS agents FROM e WHERE ts BETWEEN {NOW} - INTERVAL 7 DAY AND {NOW}")
def dashboard_overview(spark, sf_dir):
    own, n = Q.trailing(metrics(spark, sf_dir), AS_OF, "7 days"), F.count("*")
    return own.agg(n.alias("events"), Q.r6(F.avg("value")).alias("mean"), Q.r6(F.count_if("success") / n).alias("success_rate"), Q.r6(F.count_if("hit") / n).alias("hit_rate"), F.count_if(~F.col("success")).alias("errors"), F.count_distinct("agent_id").alias("agents"))


@query(f"WITH {E} SELECT operation, CAST(agent_id AS VARCHAR) AS agent_id, count(*) AS n, round(avg(value), 6) AS mean FROM e GROUP BY GROUPING SETS ((operation), (agent_id))")
def metrics_by_dimension(spark, sf_dir):
    sets = [[F.col("operation")], [F.col("agent_id")]]
    return metrics(spark, sf_dir).groupingSets(sets, "operation", "agent_id").agg(F.count("*").alias("n"), Q.r6(F.avg("value")).alias("mean")).withColumn("agent_id", F.col("agent_id").cast("string"))


@query(f"WITH {E}, r(metric_type, kind, bound, severity) AS (VALUES ('latency', 'max', 100.0, 'warning'), ('throughput', 'min', 1.0, 'critical'), ('error_rate', 'max', 200.0, 'critical')) SELECT severity, metric_type, count(*) AS n FROM e JOIN r USING (metric_type) WHERE CASE kind WHEN 'max' THEN value > bound ELSE value < bound END GROUP BY ALL")
def threshold_alerts(spark, sf_dir):
    rules = spark.createDataFrame([("latency", "max", 100.0, "warning"), ("throughput", "min", 1.0, "critical"), ("error_rate", "max", 200.0, "critical")], "metric_type string, kind string, bound double, severity string")
    return Q.alerts(metrics(spark, sf_dir), rules).groupBy("severity", "metric_type").agg(F.count("*").alias("n"))


@query(f"WITH {E}, p AS (SELECT greatest(0, 100 - (quantile_cont(value, 0.95) FILTER (metric_type = 'latency') - 100) / 9) AS latency, 100 * avg(hit::INT) AS cache, 100 * avg(success::INT) AS success FROM e) SELECT round((latency + cache + success) / 3, 6) AS score FROM p")
def system_health_score(spark, sf_dir):
    parts = metrics(spark, sf_dir).agg(F.percentile(F.when(F.col("metric_type") == "latency", F.col("value")), 0.95).alias("p95"), (100 * F.avg(F.col("hit").cast("int"))).alias("cache"), (100 * F.avg(F.col("success").cast("int"))).alias("success"))
    return parts.select(Q.r6((F.greatest(F.lit(0.0), 100 - (F.col("p95") - 100) / 9) + F.col("cache") + F.col("success")) / 3).alias("score"))


@query(f"""WITH {E}, s AS (SELECT operation, avg(value) AS value FROM e GROUP BY 1), t AS (SELECT operation, CASE WHEN value >= 41 THEN 'critical' WHEN value >= 39.5 THEN 'warning' ELSE 'healthy' END AS status FROM s)
SELECT operation, status, (SELECT CASE max(CASE status WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'healthy' END FROM t) AS overall FROM t""")
def health_status_checks(spark, sf_dir):
    return H.status_checks(metrics(spark, sf_dir).groupBy("operation").agg(F.avg("value").alias("value")), 39.5, 41.0)


@query(f"WITH {E}, o AS (SELECT *, row_number() OVER (PARTITION BY metric_type ORDER BY ts, event_id) - 1 AS i FROM e WHERE ts >= TIMESTAMP '2024-01-28') SELECT metric_type, count(*) AS n, round(regr_slope(value, i), 6) AS slope, arg_max(value, i) AS current, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM o GROUP BY 1")
def health_trend(spark, sf_dir):
    own = metrics(spark, sf_dir).where("ts >= timestamp'2024-01-28'").withColumn("i", F.row_number().over(Window.partitionBy("metric_type").orderBy("ts", "event_id")) - 1)
    return own.groupBy("metric_type").agg(F.count("*").alias("n"), Q.r6(F.regr_slope("value", "i")).alias("slope"), F.max_by("value", "i").alias("current"), Q.r6(F.avg("value")).alias("mean"), Q.r6(F.stddev_pop("value")).alias("std"))


@query(f"""WITH {E}, o AS (SELECT event_id, value, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS std, count(*) OVER w AS n FROM e WINDOW w AS (PARTITION BY agent_id ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT event_id, round((value - mean) / std, 4) AS z FROM o WHERE n = 20 AND std > 0 AND abs(value - mean) / std > 3""")
def baseline_deviation(spark, sf_dir):
    w = Window.partitionBy("agent_id").orderBy("ts", "event_id").rowsBetween(-20, -1)
    own = metrics(spark, sf_dir).select("event_id", "value", F.avg("value").over(w).alias("mean"), F.stddev_pop("value").over(w).alias("std"), F.count("*").over(w).alias("n"))
    return own.where("n = 20 and std > 0 and abs(value - mean) / std > 3").select("event_id", F.round(F.expr("(value - mean) / std"), 4).alias("z"))


@query(f"WITH {E} SELECT operation, count(*) AS total, count(*) FILTER (success) AS ok, count(*) FILTER (NOT success) AS failed, round(count(*) FILTER (success) / count(*)::DOUBLE, 6) AS rate FROM e GROUP BY 1")
def success_rates(spark, sf_dir):
    n = F.count("*")
    return metrics(spark, sf_dir).groupBy("operation").agg(n.alias("total"), F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("failed"), Q.r6(F.count_if("success") / n).alias("rate"))


@query(f"WITH {E} SELECT cache_type, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(avg(hit::INT), 6) AS rate, avg(hit::INT) < 0.5 AS alert FROM e GROUP BY ROLLUP (cache_type)")
def cache_hit_rates(spark, sf_dir):
    rate = F.avg(F.col("hit").cast("int"))
    return metrics(spark, sf_dir).rollup("cache_type").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), Q.r6(rate).alias("rate"), (rate < 0.5).alias("alert"))


@query(f"WITH {E} SELECT agent_id, round(avg(value), 6) AS mean FROM e GROUP BY 1 HAVING avg(value) > 40")
def bottlenecks(spark, sf_dir):
    return metrics(spark, sf_dir).groupBy("agent_id").agg(F.avg("value").alias("mean")).where("mean > 40").orderBy(F.desc("mean")).select("agent_id", Q.r6("mean").alias("mean"))


@query(f"""WITH {E}, a AS (SELECT operation, avg(value) FILTER (ts < TIMESTAMP '2024-01-16') AS x, avg(value) FILTER (ts >= TIMESTAMP '2024-01-16') AS y, var_samp(value) FILTER (ts < TIMESTAMP '2024-01-16') AS vx, var_samp(value) FILTER (ts >= TIMESTAMP '2024-01-16') AS vy,
  count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS nx, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS ny FROM e GROUP BY 1)
SELECT operation, round(100 * (y - x) / x, 6) AS change, round((y - x) / sqrt(vx / nx + vy / ny), 6) AS t FROM a""")
def detect_regression(spark, sf_dir):
    return X.period_change(metrics(spark, sf_dir), F.expr("ts >= timestamp'2024-01-16'"), "operation")


@query(f"WITH {E}, a AS (SELECT model_used, avg(value) AS latency, avg(success::INT) AS accuracy FROM e GROUP BY 1) SELECT model_used, round(latency, 6) AS latency, round(accuracy, 6) AS accuracy, model_used = (SELECT arg_max(model_used, accuracy) FROM a) AS pick FROM a")
def compare_models(spark, sf_dir):
    per = metrics(spark, sf_dir).groupBy("model_used").agg(F.avg("value").alias("latency"), F.avg(F.col("success").cast("int")).alias("accuracy"))
    best = per.agg(F.max_by("model_used", "accuracy").alias("best"))
    return per.crossJoin(F.broadcast(best)).select("model_used", Q.r6("latency").alias("latency"), Q.r6("accuracy").alias("accuracy"), (F.col("model_used") == F.col("best")).alias("pick"))  # one row


@query(f"""WITH {E}, l AS (SELECT * FROM e WHERE operation = 'purchase'), r AS (SELECT * FROM e WHERE operation = 'view') SELECT l.agent_id, l.event_id, r.value AS last FROM l ASOF LEFT JOIN r ON l.agent_id = r.agent_id AND l.ts >= r.ts""")
def feedback_as_of(spark, sf_dir):
    own = metrics(spark, sf_dir)
    return Q.as_of_values(own.where("operation = 'purchase'"), own.where("operation = 'view'"), "agent_id", "value")


@query(f"WITH {E}, l AS (SELECT * FROM e WHERE operation = 'purchase'), r AS (SELECT * FROM e WHERE operation = 'view'), j AS (SELECT l.value AS x, r.value AS y FROM l ASOF JOIN r ON l.agent_id = r.agent_id AND l.ts >= r.ts) SELECT round(corr(x, y), 6) AS r, count(*) AS n FROM j")
def feedback_correlation(spark, sf_dir):
    own = metrics(spark, sf_dir)
    left = own.where("operation = 'purchase'")
    both = Q.as_of_values(left, own.where("operation = 'view'"), "agent_id", "value").join(left.select("event_id", "value"), "event_id").where("last is not null")
    return both.agg(Q.r6(F.corr("value", "last")).alias("r"), F.count("*").alias("n"))


@query(f"""WITH {E}, o AS (SELECT event_id, agent_id, epoch(date_trunc('second', ts))::BIGINT AS s FROM e), w AS (SELECT event_id, s, count(*) OVER f AS before, min(s) OVER f AS first FROM o WINDOW f AS (PARTITION BY agent_id ORDER BY s RANGE BETWEEN 36000 PRECEDING AND 1 PRECEDING))
SELECT event_id, before, CAST(first + 36000 - s AS BIGINT) AS retry_after FROM w WHERE before >= 3""")
def rate_limit_violations(spark, sf_dir):
    return Q.sliding_violations(metrics(spark, sf_dir), 36000, 3, "agent_id").select("event_id", "before", "retry_after")


@query("""WITH k AS (SELECT user_id, md5('exp1:' || user_id) AS h FROM (SELECT DISTINCT user_id FROM events)), b AS (SELECT user_id, CAST(('0x' || substr(h, 1, 16)) AS UBIGINT)::HUGEINT AS hi, CAST(('0x' || substr(h, 17, 16)) AS UBIGINT)::HUGEINT AS lo FROM k),
u AS (SELECT user_id, ((hi % 1000000) * (18446744073709551616::HUGEINT % 1000000) + lo % 1000000) % 1000000 AS p FROM b)
SELECT user_id, CASE WHEN p < 500000 THEN 'control' WHEN p < 800000 THEN 'b' ELSE 'c' END AS variant FROM u""")
def assign_variant(spark, sf_dir):
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select("user_id", X.variant("exp1", "user_id", {"control": 0.5, "b": 0.3, "c": 0.2}).alias("variant"))


VARIANT = "x AS (SELECT CASE WHEN user_id % 10 < 5 THEN 'control' WHEN user_id % 10 < 8 THEN 'b' ELSE 'c' END AS variant, event_type AS metric, value FROM events), s AS (SELECT variant, metric, count(*) AS n, avg(value) AS mean, var_samp(value) AS var FROM x GROUP BY ALL)"


def results(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("case when user_id % 10 < 5 then 'control' when user_id % 10 < 8 then 'b' else 'c' end AS variant", "event_type AS metric", "value")


@query(f"WITH {VARIANT} SELECT variant, metric, n, round(mean, 6) AS mean, round(var, 6) AS var FROM s")
def experiment_summary(spark, sf_dir):
    return X.summary(results(spark, sf_dir)).select("variant", "metric", "n", Q.r6("mean").alias("mean"), Q.r6("var").alias("var"))


@query(f"""WITH {VARIANT}, c AS (SELECT * FROM s WHERE variant = 'control'), e AS (SELECT s.metric, s.variant, s.mean - c.mean AS difference, sqrt(((s.n - 1) * s.var + (c.n - 1) * c.var) / (s.n + c.n - 2)) AS pooled, s.n, c.n AS cn FROM s JOIN c ON c.metric = s.metric WHERE s.variant <> 'control')
SELECT metric, variant, round(difference, 6) AS difference, round(pooled, 6) AS pooled, round(difference / pooled, 6) AS effect, round(difference / (pooled * sqrt(1.0 / n + 1.0 / cn)), 6) AS t FROM e""")
def experiment_effects(spark, sf_dir):
    return X.effects(X.summary(results(spark, sf_dir)), "control")


# Student's tail as its finite sum: the share of the middle is a polynomial in the cosine of atan(t / sqrt(df))
TAILS = f"""{VARIANT}, c AS (SELECT * FROM s WHERE variant = 'control'), e0 AS (SELECT s.metric, s.variant, s.n >= 10 AND c.n >= 10 AS enough, s.n + c.n - 2 AS df, s.mean - c.mean AS difference, sqrt(((s.n - 1) * s.var + (c.n - 1) * c.var) / (s.n + c.n - 2)) AS pooled, s.n, c.n AS cn FROM s JOIN c ON c.metric = s.metric WHERE s.variant <> 'control'),
e1 AS (SELECT *, difference / (pooled * sqrt(1.0::DOUBLE / n + 1.0::DOUBLE / cn)) AS t, atan(abs(difference / (pooled * sqrt(1.0::DOUBLE / n + 1.0::DOUBLE / cn))) / sqrt(df)) AS th FROM e0),
k AS (SELECT metric, variant, unnest(range(1, (df - 2 - df % 2) // 2 + 1)) AS k, df, th FROM e1), l AS (SELECT metric, variant, exp(sum(ln(CASE WHEN df % 2 = 0 THEN (2 * k - 1) / (2 * k)::DOUBLE ELSE (2 * k) / (2 * k + 1)::DOUBLE END) + 2 * ln(cos(th))) OVER (PARTITION BY metric, variant ORDER BY k)) AS x FROM k),
u AS (SELECT metric, variant, 1 + sum(x) AS u FROM l GROUP BY ALL), v AS (SELECT e1.*, CASE WHEN df % 2 = 0 THEN 1 - sin(th) * coalesce(u, 1) ELSE 1 - 2 / pi() * (th + CASE WHEN df > 1 THEN sin(th) * cos(th) * coalesce(u, 1) ELSE 0 END) END AS p FROM e1 LEFT JOIN u USING (metric, variant))"""


@query(f"""WITH {TAILS} SELECT metric, variant, df, round(difference, 6) AS difference, round(t, 6) AS t, round(p, 8) AS p, enough AND p < 0.05 AS significant, enough AND difference >= 0.05 AS practical,
CASE WHEN NOT enough THEN 'Insufficient data for analysis. Continue collecting data.' WHEN p < 0.05 AND difference >= 0.05 THEN 'Strong evidence favoring treatment. Recommend implementing.' WHEN p < 0.05 THEN 'Statistically significant but effect size too small. Consider cost/benefit.'
  ELSE 'No statistically significant difference detected. Continue monitoring or stop experiment.' END AS advice FROM v""")
def experiment_significance(spark, sf_dir):
    out = X.analysed(X.summary(results(spark, sf_dir)), "control", target=0.05)
    return out.select("metric", "variant", "df", Q.r6("difference").alias("difference"), Q.r6("t").alias("t"), F.round("p", 8).alias("p"), "significant", "practical", "advice")


@query()  # SQL has no inverse of Student's law: tests hold the intervals against tables
def experiment_intervals(spark, sf_dir):
    out = X.analysed(X.summary(results(spark, sf_dir)), "control")
    return out.select("metric", "variant", Q.r6("ci_lower").alias("ci_lower"), Q.r6("ci_upper").alias("ci_upper"))


@query(f"WITH {VARIANT}, c AS (SELECT * FROM s WHERE variant = 'control' AND mean > 0), i AS (SELECT s.variant, (s.mean - c.mean) / c.mean AS change FROM s JOIN c ON c.metric = s.metric WHERE s.variant <> 'control') SELECT variant, round(avg(change), 6) AS change, avg(change) >= 0.05 AND min(change) >= -0.1 AS success, min(change) < -0.1 AS rollback FROM i GROUP BY 1")
def evaluate_improvement(spark, sf_dir):
    return X.improvement(X.summary(results(spark, sf_dir)), "control")


@query(f"WITH {P} SELECT template_id, count(*) AS uses, count(*) FILTER (success) AS successes, round(avg(confidence), 6) AS confidence, round(avg(latency_ms), 6) AS latency, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_used FROM p GROUP BY 1")
def prompt_stats(spark, sf_dir):
    return prompts(spark, sf_dir).groupBy("template_id").agg(F.count("*").alias("uses"), F.count_if("success").alias("successes"), Q.r6(F.avg("confidence")).alias("confidence"), Q.r6(F.avg("latency_ms")).alias("latency"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_used"))


PM = f"{P}, pm AS (SELECT template_id, count(*) AS uses, avg(success::INT) AS success, avg(confidence) AS confidence, avg(latency_ms) AS latency FROM p WHERE ts BETWEEN {NOW} - INTERVAL 7 DAY AND {NOW} GROUP BY 1)"


@query(f"WITH {PM} SELECT template_id, uses, round(success, 6) AS success, round(confidence, 6) AS confidence, round(latency, 6) AS latency, round(least(1.0, (1 - success + 1 - confidence) / 2 * CASE WHEN uses > 100 THEN 1.5 ELSE 1 END), 6) AS priority FROM pm")
def prompt_metrics(spark, sf_dir):
    per = Q.trailing(prompts(spark, sf_dir), AS_OF, "7 days").groupBy("template_id").agg(F.count("*").alias("uses"), F.avg(F.col("success").cast("int")).alias("success"), F.avg("confidence").alias("confidence"), F.avg("latency_ms").alias("latency"))
    priority = F.least(F.lit(1.0), (2 - F.col("success") - F.col("confidence")) / 2 * F.when(F.col("uses") > 100, 1.5).otherwise(1.0))
    return per.select("template_id", "uses", *[Q.r6(c).alias(c) for c in ("success", "confidence", "latency")], Q.r6(priority).alias("priority"))


@query(f"""WITH {P}, o AS (SELECT *, row_number() OVER (PARTITION BY template_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY template_id) AS n FROM p), h AS (SELECT template_id, n, avg(success::INT) FILTER (i <= n // 2) AS a, avg(success::INT) FILTER (i > n // 2) AS b FROM o GROUP BY ALL)
SELECT template_id, CASE WHEN n < 10 THEN 'insufficient' WHEN b > a + 0.02 THEN 'improving' WHEN b < a - 0.02 THEN 'declining' ELSE 'stable' END AS trend FROM h""")
def prompt_trends(spark, sf_dir):
    w = Window.partitionBy("template_id")
    own = prompts(spark, sf_dir).select("template_id", F.col("success").cast("int").alias("s"), F.row_number().over(w.orderBy("ts", "event_id")).alias("i"), F.count("*").over(w).alias("n"))
    half = own.groupBy("template_id", "n").agg(F.avg(F.when(F.col("i") <= F.floor(F.col("n") / 2), F.col("s"))).alias("a"), F.avg(F.when(F.col("i") > F.floor(F.col("n") / 2), F.col("s"))).alias("b"))
    return half.select("template_id", F.expr("case when n < 10 then 'insufficient' when b > a + 0.02D then 'improving' when b < a - 0.02D then 'declining' else 'stable' end").alias("trend"))


@query(f"WITH {P} SELECT template_id, error_message AS pattern, count(*) AS n FROM p WHERE NOT success GROUP BY ALL HAVING count(*) >= 3")
def failure_patterns(spark, sf_dir):
    return prompts(spark, sf_dir).where("not success").groupBy("template_id", F.col("error_message").alias("pattern")).agg(F.count("*").alias("n")).where("n >= 3")


@query(f"WITH {PM} SELECT round((avg(success) + avg(confidence)) / 2, 6) AS health, count(*) FILTER (success < 0.8) AS low FROM pm")
def prompt_health(spark, sf_dir):
    per = Q.trailing(prompts(spark, sf_dir), AS_OF, "7 days").groupBy("template_id").agg(F.avg(F.col("success").cast("int")).alias("success"), F.avg("confidence").alias("confidence"))
    return per.agg(Q.r6((F.avg("success") + F.avg("confidence")) / 2).alias("health"), F.count_if(F.col("success") < 0.8).alias("low"))


@query("SELECT conv_id, md5(arg_max(text, turn)) AS last FROM conversations WHERE role = 'user' GROUP BY 1")
def last_user_message(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.md5(F.max_by("text", "turn")).alias("last"))


@query("WITH l AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, md5('User: ' || text || chr(10) || 'Assistant: ' || next) AS stored FROM l WHERE role = 'user' AND next_role = 'assistant'")
def conversation_pairs(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    own = table(spark, sf_dir, "conversations").withColumns({"next_role": F.lead("role").over(w), "next": F.lead("text").over(w)})
    return own.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.md5(F.concat(F.lit("User: "), "text", F.lit("\nAssistant: "), "next")).alias("stored"))


CW = WORDS.format("text")


@query(f"SELECT conv_id, CAST(sum(CASE WHEN role = 'assistant' THEN 0 ELSE len({CW}) END) AS BIGINT) AS prompt, CAST(sum(CASE WHEN role = 'assistant' THEN len({CW}) ELSE 0 END) AS BIGINT) AS completion FROM conversations GROUP BY 1")
def token_usage(spark, sf_dir):
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    own = table(spark, sf_dir, "conversations").withColumn("n", n)
    return own.groupBy("conv_id").agg(F.sum(F.when(F.col("role") == "assistant", 0).otherwise(F.col("n"))).alias("prompt"), F.sum(F.when(F.col("role") == "assistant", F.col("n")).otherwise(0)).alias("completion"))


@query("SELECT conv_id, turn, role, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) BETWEEN 2 AND 4")
def conversation_page(spark, sf_dir):
    w = Window.partitionBy("conv_id")
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.count("*").over(w).alias("total"), F.row_number().over(w.orderBy("turn")).alias("i"))
    return own.where("i between 2 and 4").drop("i")


@query(f"WITH {E} SELECT agent_id, operation AS tool, count(*) AS calls, count(*) FILTER (success) AS ok, round(avg(value * 10), 6) AS mean_ms FROM e GROUP BY ALL")
def agent_activity(spark, sf_dir):
    return metrics(spark, sf_dir).groupBy("agent_id", F.col("operation").alias("tool")).agg(F.count("*").alias("calls"), F.count_if("success").alias("ok"), Q.r6(F.avg(F.col("value") * 10)).alias("mean_ms"))


@query(f"""WITH {E}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 600 MINUTE THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY agent_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY agent_id ORDER BY ts, event_id) AS session FROM g)
SELECT agent_id, CAST(session AS BIGINT) AS session, count(*) AS events, CAST(epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))) AS BIGINT) AS seconds FROM s GROUP BY ALL""")
def sessionize(spark, sf_dir):
    return Q.sessions(metrics(spark, sf_dir), 600, "agent_id")


SCORE = "0.3 * (1 - least(days_since_access / 30.0::DOUBLE, 1)) + 0.3 * least(access_count / 10.0::DOUBLE, 1) + 0.3 * confidence_score + 0.1 * (1 - hallucination_score)"
HEALTH = f"{UL}, h AS (SELECT *, {SCORE} AS score FROM u)"
BUCKET = "CASE WHEN score >= 0.8 THEN 'excellent' WHEN score >= 0.6 THEN 'good' WHEN score >= 0.4 THEN 'fair' WHEN score >= 0.2 THEN 'poor' ELSE 'critical' END"


@query(f"WITH {HEALTH} SELECT id, round(score, 6) AS score, {BUCKET} AS status FROM h")
def memory_health(spark, sf_dir):
    return H.memory_health(usage(spark, sf_dir)).select("id", Q.r6("score").alias("score"), "status")


@query(f"WITH {HEALTH} SELECT agent_id, round(avg(score), 6) AS mean, count(*) AS n, count(*) FILTER (score < 0.4) AS problematic FROM h GROUP BY ROLLUP (agent_id)")
def memory_health_report(spark, sf_dir):
    return H.memory_health(usage(spark, sf_dir)).rollup("agent_id").agg(Q.r6(F.avg("score")).alias("mean"), F.count("*").alias("n"), F.count_if(F.col("score") < 0.4).alias("problematic"))


STALE = f"{UL}, st AS (SELECT id, least(1.0, days_since_access / 90.0::DOUBLE) * 0.7 + (1 - least(access_count / 5.0::DOUBLE, 1)) * 0.3 AS staleness FROM u WHERE days_since_access > 30 AND access_count < 5)"


@query(f"WITH {STALE} SELECT id, round(staleness, 6) AS staleness, CASE WHEN staleness > 0.9 THEN 'delete' WHEN staleness > 0.7 THEN 'archive' ELSE 'monitor' END AS action FROM st")
def stale_memories(spark, sf_dir):
    return H.stale(usage(spark, sf_dir), 30, 5).select("id", Q.r6("staleness").alias("staleness"), "action")


@query("SELECT md5(text) AS content_hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query(f"WITH {UL} SELECT id, CASE WHEN confidence_score < 0.4 THEN 'delete' ELSE 'review' END AS action, (CASE WHEN confidence_score < 0.6 THEN 1 ELSE 0 END) + (CASE WHEN hallucination_score > 0.4 THEN 1 ELSE 0 END) AS issues FROM u WHERE confidence_score < 0.6 OR hallucination_score > 0.4")
def low_confidence_memories(spark, sf_dir):
    return H.doubtful(usage(spark, sf_dir), 0.6).select("id", "action", "issues")


PLAN = f"""{STALE}, pl AS (SELECT id, CASE WHEN staleness > 0.9 THEN 'delete' ELSE 'archive' END AS action, 'stale' AS reason FROM st WHERE staleness > 0.8
  UNION ALL SELECT id, 'delete', 'low_confidence' FROM u WHERE confidence_score < 0.4 UNION ALL SELECT doc_id, 'merge', 'duplicate' FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS i FROM documents) WHERE i > 1)"""


def plan(spark, sf_dir):
    return H.cleanup_plan(usage(spark, sf_dir), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("h")))


@query(f"WITH {PLAN} SELECT * FROM pl")
def plan_cleanup(spark, sf_dir):
    return plan(spark, sf_dir)


@query(f"WITH {PLAN} SELECT action, reason, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS saved_chars FROM pl JOIN u USING (id) GROUP BY ALL")
def cleanup_dry_run(spark, sf_dir):
    return plan(spark, sf_dir).join(usage(spark, sf_dir).select("id", "n_chars"), "id").groupBy("action", "reason").agg(F.count("*").alias("n"), F.sum("n_chars").alias("saved_chars"))


@query(f"WITH {PLAN}, {M}, gone AS (SELECT DISTINCT id FROM pl WHERE action IN ('delete', 'merge')), shelved AS (SELECT DISTINCT id FROM pl WHERE action = 'archive') SELECT id, CASE WHEN id IN (FROM shelved) THEN 'archived' ELSE status END AS status FROM m WHERE id NOT IN (FROM gone)")
def execute_cleanup(spark, sf_dir):
    return H.cleaned(memories(spark, sf_dir), plan(spark, sf_dir)).select("id", "status")


@query(f"WITH {M} SELECT agent_id, count(*) FILTER (status = 'active') AS active, count(*) AS total, count(*) FILTER (created_at >= TIMESTAMP '2024-01-29') AS recent FROM m GROUP BY 1")
def memory_stats(spark, sf_dir):
    return memories(spark, sf_dir).groupBy("agent_id").agg(F.count_if(F.col("status") == "active").alias("active"), F.count("*").alias("total"), F.count_if(F.expr("created_at >= timestamp'2024-01-29'")).alias("recent"))


@query(f"WITH {M} SELECT count(*) AS memories, count(DISTINCT agent_id) AS agents, count(DISTINCT session_id) AS sessions, round(avg(length(content)), 6) AS mean_chars, CAST(sum(length(content)) AS BIGINT) AS chars, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS oldest, count(*) FILTER (expires_at < {NOW}) AS expired FROM m")
def store_stats(spark, sf_dir):
    n = F.length("content")
    return memories(spark, sf_dir).agg(F.count("*").alias("memories"), F.count_distinct("agent_id").alias("agents"), F.count_distinct("session_id").alias("sessions"), Q.r6(F.avg(n)).alias("mean_chars"), F.sum(n).alias("chars"), F.date_format(F.min("created_at"), "yyyy-MM-dd HH:mm:ss").alias("oldest"), F.count_if(F.expr(f"expires_at < timestamp'{AS_OF}'")).alias("expired"))


@query(f"WITH {M}, v AS (SELECT agent_id, session_id, id, created_at, row_number() OVER (PARTITION BY agent_id, session_id ORDER BY created_at DESC, id DESC) AS n, lag(created_at) OVER (PARTITION BY agent_id, session_id ORDER BY created_at DESC, id DESC) AS valid_to FROM m) SELECT id, CAST(n AS INTEGER) AS n, n = 1 AS current, {DSTAMP.format('valid_to')} FROM v WHERE n <= 10")
def fact_versions(spark, sf_dir):
    out = H.versions(memories(spark, sf_dir), 10, "agent_id", "session_id")
    return out.select("id", "n", "current", F.date_format("valid_to", "yyyy-MM-dd HH:mm:ss").alias("valid_to"))


@query(f"WITH {M} SELECT agent_id, CAST(hour(created_at) AS VARCHAR) AS hour, count(*) AS n FROM m GROUP BY GROUPING SETS ((agent_id), (hour(created_at)))")
def memory_analytics(spark, sf_dir):
    own = memories(spark, sf_dir).withColumn("hour", F.hour("created_at"))
    return own.groupingSets([[F.col("agent_id")], [F.col("hour")]], "agent_id", "hour").agg(F.count("*").alias("n")).withColumn("hour", F.col("hour").cast("string"))

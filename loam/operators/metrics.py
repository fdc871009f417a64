"""Roll-ups, baselines, anomalies, trends and health of metric streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POINTS = (0.5, 0.9, 0.95, 0.99)


def r6(x: Column | str) -> Column:
    return F.round(x, 6)


def summary(df: DataFrame, *keys: str | Column, value: str = "value") -> DataFrame:
    """count, sum, min, max, mean, population deviation and interpolated percentiles."""
    at = F.percentile(value, F.array(*map(F.lit, POINTS)))
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), r6(F.sum(value)).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"), r6(F.avg(value)).alias("mean"), r6(F.stddev_pop(value)).alias("std"), at.alias("__p"))
    names = [c for c in out.columns if c != "__p"]
    return out.select(*names, *[r6(F.col("__p")[i]).alias(f"p{round(p * 100)}") for i, p in enumerate(POINTS)])


def trailing(df: DataFrame, as_of: str, interval: str, at: str = "ts") -> DataFrame:
    return df.where(F.col(at).between(F.expr(f"timestamp'{as_of}' - interval {interval}"), F.expr(f"timestamp'{as_of}'")))


def series(df: DataFrame, grain: str, start: str, end: str, value: str = "value") -> DataFrame:
    """Counts and means per time step, steps without rows included."""
    steps = df.sparkSession.range(1).select(F.explode(F.expr(f"sequence(timestamp'{start}', timestamp'{end}', interval 1 {grain})")).alias("step"))
    got = df.groupBy(F.date_trunc(grain, "ts").alias("step")).agg(F.count(value).alias("n"), r6(F.avg(value)).alias("mean"))
    return steps.join(got, "step", "left").select("step", F.coalesce("n", F.lit(0)).alias("n"), "mean")


def newest(df: DataFrame, most: int, *keys: str, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The newest rows of each key, numbered from the oldest of them as i."""
    down = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    kept = df.withColumn("__n", F.row_number().over(down)).where(F.col("__n") <= most).drop("__n")
    return kept.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def baselines(df: DataFrame, most: int = 1000, least: int = 100) -> DataFrame:
    return summary(newest(df, most, "metric_type", "operation"), "metric_type", "operation").where(F.col("n") >= least)


def trends(df: DataFrame, most: int = 50, least: int = 10) -> DataFrame:
    """Least-squares line over the newest values of each operation."""
    own = newest(df, most, "operation")
    fit = own.groupBy("operation").agg(F.count("*").alias("n"), F.regr_slope("value", "i").alias("slope"), F.regr_r2("value", "i").alias("r2")).where(F.col("n") >= least)
    direction = F.when(F.col("slope") > 0, "increasing").when(F.col("slope") < 0, "decreasing").otherwise("stable")
    return fit.select("operation", "n", r6("slope").alias("slope"), r6(F.coalesce("r2", F.lit(0.0))).alias("r2"), direction.alias("direction"))


def against(df: DataFrame, base: DataFrame) -> DataFrame:
    """Rows with their baseline, their deviation in units of its spread, and their rank against it."""
    joined = df.join(F.broadcast(base.select("metric_type", "operation", "mean", "std", "p50", "p95", "p99")), ["metric_type", "operation"])  # one row per metric and operation
    v = F.col("value")
    rank = (
        F.when(v <= F.col("p50"), 50 * F.try_divide(v, "p50"))
        .when(v <= F.col("p95"), 50 + 45 * F.try_divide(v - F.col("p50"), F.col("p95") - F.col("p50")))
        .when(v <= F.col("p99"), 95 + 4 * F.try_divide(v - F.col("p95"), F.col("p99") - F.col("p95")))
        .otherwise(F.lit(99.5))
    )
    return joined.withColumns({"sigmas": F.try_divide(F.abs(v - F.col("mean")), "std"), "rank": rank})


def severity() -> Column:
    s, rank = F.coalesce("sigmas", F.lit(0.0)), F.coalesce("rank", F.lit(0.0))
    return F.when((s > 4) | (rank > 99.5), "critical").when((s > 3) | (rank > 95), "warning").otherwise("info")


def correlation(x: str, y: str) -> Column:
    """Pearson's coefficient, null where a side is constant (the built-in one divides by zero there)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(df: DataFrame, least: int = 5, strong: float = 0.8) -> DataFrame:
    """Pairs of metrics within fixed windows, paired by position, that move together."""
    own = df.withColumn("w", F.date_trunc("hour", "ts")).withColumn("i", F.row_number().over(Window.partitionBy("w", "metric_type").orderBy("ts", "event_id")))
    x, y = (own.select("w", "i", F.col("metric_type").alias(m), F.col("value").alias(v)) for m, v in (("m1", "v1"), ("m2", "v2")))
    pairs = x.join(y, ["w", "i"]).where("m1 < m2").groupBy("w", "m1", "m2").agg(F.count("*").alias("n"), correlation("v1", "v2").alias("r"))
    return pairs.where((F.col("n") >= least) & (F.abs("r") > strong)).select("w", "m1", "m2", "n", r6("r").alias("r"))


def alerts(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows that break a rule (metric_type, kind min/max, bound, severity)."""
    joined = df.join(F.broadcast(rules), "metric_type")  # a row per metric
    return joined.where(F.when(F.col("kind") == "max", F.col("value") > F.col("bound")).otherwise(F.col("value") < F.col("bound")))


def sliding_violations(df: DataFrame, seconds: int, limit: int, *keys: str) -> DataFrame:
    """Rows whose key had at least `limit` rows in the seconds before, and how long to wait."""
    own = df.withColumn("__s", F.unix_seconds("ts"))
    frame = Window.partitionBy(*keys).orderBy("__s").rangeBetween(-seconds, -1)
    out = own.withColumns({"before": F.count("*").over(frame), "__first": F.min("__s").over(frame)}).where(F.col("before") >= limit)
    return out.withColumn("retry_after", F.col("__first") + seconds - F.col("__s")).drop("__s", "__first")


def sessions(df: DataFrame, minutes: int, key: str) -> DataFrame:
    """Runs of rows of a key without a gap longer than `minutes`."""
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    gap = F.coalesce(F.col("ts") - F.lag("ts").over(order) > F.expr(f"interval {minutes} minutes"), F.lit(True))
    own = df.withColumn("__new", gap.cast("int")).withColumn("session", F.sum("__new").over(order))
    return own.groupBy(key, "session").agg(F.count("*").alias("events"), (F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))).alias("seconds"))


def as_of_values(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Each left row with the last right value of its key at or before it, by one union and one window."""
    both = left.select(key, "ts", "event_id", F.lit(1).alias("side"), F.lit(None).cast("double").alias("__v")).unionByName(right.select(key, "ts", "event_id", F.lit(0).alias("side"), F.col(value).alias("__v")))
    order = Window.partitionBy(key).orderBy("ts", "side", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("last", F.last("__v", ignorenulls=True).over(order)).where("side = 1").select(key, "event_id", "last")


#: What a pattern suggests: kind, its one or two metrics in order of name, direction, advice.
ADVICE = (
    ("trend", "latency", None, "increasing", "look for a bottleneck or a slower release"),
    ("trend", "error_rate", None, "increasing", "look for failing dependencies and recent deployments"),
    ("trend", "memory_usage", None, "increasing", "look for leaks and long-lived objects"),
    ("trend", "throughput", None, "decreasing", "look for contention and missing capacity"),
    ("trend", "cache_hit_rate", None, "decreasing", "review size, eviction and warming of the cache"),
    ("correlation", "error_rate", "latency", "increasing", "review timeouts, connection pools and circuit breakers"),
    ("correlation", "cache_hit_rate", "latency", "decreasing", "warm the cache and review its lifetimes"),
    ("correlation", "latency", "memory_usage", "increasing", "watch memory pressure and garbage collection"),
)


def metric_trends(df: DataFrame, most: int = 50, least: int = 10, fit: float = 0.5) -> DataFrame:
    """Per operation and metric the line through its values among the newest of the operation, where it explains them."""
    own = newest(df, most, "operation").drop("i")
    own = own.withColumn("i", F.row_number().over(Window.partitionBy("operation", "metric_type").orderBy("ts", "event_id")) - 1)
    lines = own.groupBy("operation", "metric_type").agg(F.count("*").alias("n"), F.regr_slope("value", "i").alias("slope"), F.regr_r2("value", "i").alias("r2"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return lines.where((F.col("n") >= least) & (F.col("r2") >= fit) & (F.col("slope") != 0))


def correlated_windows(df: DataFrame, window: str = "5 minutes", events: int = 10, least: int = 5, strong: float = 0.8) -> DataFrame:
    """Windows with enough events in which two metrics, paired by their place in it, move together."""
    own = df.withColumn("w", F.window("ts", window)["start"])
    own = own.withColumn("i", F.row_number().over(Window.partitionBy("w", "metric_type").orderBy("ts", "event_id")))
    full = own.groupBy("w").agg(F.count("*").alias("events")).where(F.col("events") >= events)
    x, y = (own.select("w", "i", F.col("metric_type").alias(m), F.col("value").alias(v)) for m, v in (("m1", "v1"), ("m2", "v2")))
    pairs = x.join(y, ["w", "i"]).where("m1 < m2").groupBy("w", "m1", "m2").agg(F.count("*").alias("n"), correlation("v1", "v2").alias("r"))
    return pairs.where((F.col("n") >= least) & (F.abs("r") > strong)).join(full, "w", "left_semi")


def patterns(df: DataFrame, confidence: float = 0.5, window: str = "5 minutes", fit: float = 0.5) -> DataFrame:
    """Trends and correlations of at least this confidence with their advice; rank 1 has the largest impact times confidence.

    A trend is as sure as its line fits and weighs as its slope. A correlation that is met in one window has a
    confidence of 0.7, a tenth more for each further window, and weighs as its first window's coefficient.
    Ties go by the pattern's name. There is a row for each pattern, a number that operations and metrics bound.
    """
    line, name = F.when(F.col("slope") > 0, "increasing").otherwise("decreasing"), F.concat_ws
    trend = metric_trends(df, fit=fit).select(
        F.lit("trend").alias("kind"), name("_", F.lit("trend"), "operation", "metric_type", line).alias("pattern"), F.col("metric_type").alias("metric"), F.lit(None).cast("string").alias("other"),
        line.alias("direction"), F.col("r2").alias("confidence"), F.abs("slope").alias("impact"), F.lit(1).cast("long").alias("seen"), "first_seen", "last_seen",
    )
    met = correlated_windows(df, window).groupBy("m1", "m2").agg(F.count("*").alias("seen"), F.min_by("r", "w").alias("r"), F.min("w").alias("first_seen"), F.max("w").alias("last_seen"))
    both = met.select(
        F.lit("correlation").alias("kind"), name("_", F.lit("correlation"), "m1", "m2").alias("pattern"), F.col("m1").alias("metric"), F.col("m2").alias("other"),
        F.when(F.col("r") > 0, "increasing").otherwise("decreasing").alias("direction"), F.least(F.lit(1.0), 0.6 + 0.1 * F.col("seen")).alias("confidence"), F.abs("r").alias("impact"), "seen", "first_seen", "last_seen",
    )
    found = trend.unionByName(both).where(F.round("confidence", 9) >= confidence)
    rules = df.sparkSession.createDataFrame(list(ADVICE), "kind string, metric string, other string, direction string, advice string")
    keys = [F.col(f"p.{c}").eqNullSafe(F.col(f"a.{c}")) for c in ("kind", "metric", "other", "direction")]
    told = found.alias("p").join(F.broadcast(rules).alias("a"), keys, "left").select("p.*", F.coalesce("a.advice", F.lit("")).alias("advice"))  # the rules above
    return told.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round(F.col("impact") * F.col("confidence"), 9)), "pattern")))

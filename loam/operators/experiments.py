"""Variant assignment and effects of experiments."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def variant(experiment: str, key: str, weights: dict[str, float]) -> Column:
    """The variant of a key: MD5(experiment:key) modulo a million against cumulative weights; the last one takes the rest."""
    h = F.md5(F.concat(F.lit(f"{experiment}:"), F.col(key).cast("string")))
    high, low = (F.conv(F.substring(h, at, 16), 16, 10).cast("decimal(38,0)") for at in (1, 17))
    million = F.lit(1_000_000).cast("decimal(38,0)")
    place = ((high % million) * F.lit((1 << 64) % 1_000_000) + low % million) % million
    out, total, names = F.lit(None).cast("string"), 0.0, list(weights)
    total = 1.0 - weights[names[-1]]
    out = F.lit(names[-1])
    for name in reversed(names[:-1]):
        out = F.when(place < F.lit(round(total * 1_000_000)), name).otherwise(out)
        total -= weights[name]
    return out


def summary(results: DataFrame) -> DataFrame:
    return results.groupBy("variant", "metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"))


def effects(per: DataFrame, control: str) -> DataFrame:
    """Each variant against the control: difference, pooled deviation, Cohen's d and Student's t."""
    base = per.where(F.col("variant") == control).select("metric", F.col("n").alias("cn"), F.col("mean").alias("cm"), F.col("var").alias("cv"))
    own = per.where(F.col("variant") != control).join(base, "metric")
    own = own.withColumns({"difference": F.col("mean") - F.col("cm"), "pooled": F.sqrt(((F.col("n") - 1) * F.col("var") + (F.col("cn") - 1) * F.col("cv")) / (F.col("n") + F.col("cn") - 2))})
    effect = F.try_divide("difference", "pooled")
    t = F.try_divide(F.col("difference"), F.col("pooled") * F.sqrt(1 / F.col("n") + 1 / F.col("cn")))
    return own.select("metric", "variant", *[F.round(x, 6).alias(n) for n, x in (("difference", F.col("difference")), ("pooled", F.col("pooled")), ("effect", effect), ("t", t))])


def beta_share(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function by its continued fraction, from the side where that converges fast."""
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.array([math.lgamma(u + v) - math.lgamma(u) - math.lgamma(v) for u, v in zip(p, q, strict=True)]) + p * np.log(y) + q * np.log1p(-y)
    tiny = 1e-300
    guard = lambda z: np.where(np.abs(z) < tiny, tiny, z)
    c, d = np.ones_like(y), 1 / guard(1 - (p + q) * y / (p + 1))
    h = d.copy()
    for m in range(1, 2000):
        e = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        d, c = 1 / guard(1 + e * d), guard(1 + e / c)
        h = h * d * c
        e = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        d, c = 1 / guard(1 + e * d), guard(1 + e / c)
        h, last = h * d * c, d * c
        if (np.abs(last - 1) < 1e-15).all():
            break
    out = np.where(y > 0, np.exp(front) * h / p, 0.0)
    return np.where(swap, 1 - out, out)


def student_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) of Student's law."""
    t, df = np.abs(np.asarray(t, float)), np.asarray(df, float)
    return beta_share(df / 2, 0.5, df / (df + t * t))


def student_critical(level: float, df: np.ndarray) -> np.ndarray:
    """The t whose two-sided tail is `level`, by bisection on a scale that holds all of (0, infinity)."""
    df = np.asarray(df, float)
    low, high = np.zeros_like(df), np.ones_like(df)
    for _ in range(80):
        middle = (low + high) / 2
        above = student_tail(middle / (1 - middle), df) > level
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return low / (1 - low)


def significance(per: DataFrame, level: float = 0.05) -> DataFrame:
    """p value and verdict of every t, by the degrees of freedom in `df`; without such a column by the normal law."""

    @F.pandas_udf("double")
    def p_value(t: pd.Series, df: pd.Series) -> pd.Series:
        normal = np.array([math.erfc(abs(x) / math.sqrt(2)) for x in t])
        return pd.Series(np.where(df > 0, student_tail(t, np.where(df > 0, df, 1)), normal))

    df = F.col("df").cast("double") if "df" in per.columns else F.lit(None).cast("double")
    return per.withColumn("p", F.round(p_value("t", df), 6)).withColumn("significant", F.col("p") < level)


def analysed(per: DataFrame, control: str, level: float = 0.05, target: float | None = None, higher_is_better: bool = True, least: int = 10) -> DataFrame:
    """Each variant against the control: t, degrees of freedom, p, confidence interval of the difference, verdicts, advice.

    per: variant, metric, n, mean, var, as `summary` has them. Fewer than `least` values on either side: no verdict, p is 1
    and figures are 0. target: the difference that matters in practice. Values without any spread: t is null, p is 1.
    Student's law is computed on these summary rows only.
    """

    @F.pandas_udf("p double, critical double")
    def tails(t: pd.Series, df: pd.Series) -> pd.DataFrame:
        known, safe = t.notna() & (df > 0), np.where(df > 0, df, 1)
        p = np.where(known, student_tail(t.fillna(0), safe), 1.0)
        return pd.DataFrame({"p": p, "critical": student_critical(level, safe)})

    base = per.where(F.col("variant") == control).select("metric", F.col("n").alias("cn"), F.col("mean").alias("cm"), F.col("var").alias("cv"))
    own = per.where(F.col("variant") != control).join(base, "metric").withColumn("enough", (F.col("n") >= least) & (F.col("cn") >= least))
    own = own.withColumns({"df": F.col("n") + F.col("cn") - 2, "difference": F.col("mean") - F.col("cm")})
    own = own.withColumn("pooled", F.sqrt(((F.col("n") - 1) * F.col("var") + (F.col("cn") - 1) * F.col("cv")) / F.col("df")))
    own = own.withColumn("error", F.col("pooled") * F.sqrt(1 / F.col("n") + 1 / F.col("cn"))).withColumn("t", F.when(F.col("error") > 0, F.col("difference") / F.col("error")))
    own = own.withColumn("effect", F.coalesce(F.when(F.col("pooled") > 0, F.col("difference") / F.col("pooled")), F.lit(0.0))).withColumn("tails", tails("t", "df"))
    significant = F.col("enough") & (F.col("tails.p") < level)
    matters = F.lit(False) if target is None else F.col("enough") & ((F.col("difference") if higher_is_better else -F.col("difference")) >= target)
    favoured = F.col("effect") > 0 if higher_is_better else F.col("effect") < 0
    advice = F.when(~F.col("enough"), "Insufficient data for analysis. Continue collecting data.").when(significant & matters, F.when(favoured, "Strong evidence favoring treatment. Recommend implementing.").otherwise("Statistically significant but favors control. Do not implement."))
    advice = advice.when(significant, "Statistically significant but effect size too small. Consider cost/benefit.").otherwise("No statistically significant difference detected. Continue monitoring or stop experiment.")
    zero = lambda x: F.when(F.col("enough"), x).otherwise(F.lit(0.0))
    reach = F.col("tails.critical") * F.col("error")
    return own.select("metric", "variant", "df", zero(F.col("difference")).alias("difference"), zero(F.col("effect")).alias("effect"), F.when(F.col("enough"), F.col("t")).alias("t"), F.when(F.col("enough"), F.col("tails.p")).otherwise(1.0).alias("p"),
        zero(F.col("difference") - reach).alias("ci_lower"), zero(F.col("difference") + reach).alias("ci_upper"), significant.alias("significant"), matters.alias("practical"), advice.alias("advice"))


def improvement(per: DataFrame, control: str) -> DataFrame:
    """Mean relative change of a variant's metrics, whether that is a success, and whether to roll back."""
    base = per.where(F.col("variant") == control).where("mean > 0").select("metric", F.col("mean").alias("cm"))
    own = per.where(F.col("variant") != control).join(base, "metric").withColumn("change", (F.col("mean") - F.col("cm")) / F.col("cm"))
    return own.groupBy("variant").agg(F.round(F.avg("change"), 6).alias("change"), ((F.avg("change") >= 0.05) & (F.min("change") >= -0.1)).alias("success"), (F.min("change") < -0.1).alias("rollback"))


def period_change(df: DataFrame, recent: Column, key: str) -> DataFrame:
    """Change of the mean between two periods in per cent, and Welch's t, in one pass."""
    old, new = F.when(~recent, F.col("value")), F.when(recent, F.col("value"))
    own = df.groupBy(key).agg(F.avg(old).alias("x"), F.avg(new).alias("y"), F.var_samp(old).alias("vx"), F.var_samp(new).alias("vy"), F.count(old).alias("nx"), F.count(new).alias("ny"))
    return own.select(key, F.round(F.expr("100 * (y - x) / x"), 6).alias("change"), F.round(F.expr("(y - x) / sqrt(vx / nx + vy / ny)"), 6).alias("t"))

"""Student's law against its finite sums and tables, and the verdicts that rest on it."""

from __future__ import annotations

import math

import numpy as np
import pytest

from loam.operators import experiments as X


def plain_tail(t: float, df: int) -> float:
    """Two-sided tail by the finite sum over powers of the cosine."""
    angle = math.atan(abs(t) / math.sqrt(df))
    c, term, total = math.cos(angle) ** 2, 1.0, 0.0
    if df % 2 == 0:
        for k in range(1, df // 2 + 1):
            total, term = total + term, term * (2 * k - 1) / (2 * k) * c
        return 1 - math.sin(angle) * total
    for k in range(1, (df - 1) // 2 + 1):
        total, term = total + term, term * 2 * k / (2 * k + 1) * c
    return 1 - 2 / math.pi * (angle + math.sin(angle) * math.cos(angle) * total)


def test_tails_of_every_degree():
    df = np.repeat(np.arange(1, 1001), 6)
    t = np.tile([0.0, 0.3, 1.0, -1.96, 2.58, 4.2], 1000)
    assert np.abs(X.student_tail(t, df) - [plain_tail(a, int(b)) for a, b in zip(t, df, strict=True)]).max() < 1e-10
    assert X.student_tail(np.array([1e9, 40.0]), np.array([1, 1000])) == pytest.approx([2 / math.pi / 1e9, 0.0], abs=1e-12)


def test_critical_values():
    table = {1: 12.706204736, 2: 4.302652730, 3: 3.182446305, 5: 2.570581836, 10: 2.228138852, 30: 2.042272456, 100: 1.983971519, 1000: 1.962339081}
    assert X.student_critical(0.05, np.array(list(table))) == pytest.approx(list(table.values()), abs=1e-8)
    df = np.arange(1, 1001)
    for level in (0.2, 0.05, 0.001):
        assert np.abs(X.student_tail(X.student_critical(level, df), df) - level).max() < 1e-12


def test_verdicts(spark):
    rows = [(v, m, n, mean, var) for m, cells in {
        "better": [("control", 500, 1.0, 0.04), ("new", 400, 1.2, 0.05)], "small": [("control", 9000, 1.0, 0.04), ("new", 9000, 1.01, 0.04)], "worse": [("control", 500, 1.2, 0.04), ("new", 400, 1.0, 0.05)],
        "none": [("control", 20, 1.0, 1.0), ("new", 20, 1.1, 1.0)], "few": [("control", 9, 1.0, 1.0), ("new", 400, 9.0, 1.0)], "flat": [("control", 50, 1.0, 0.0), ("new", 50, 1.0, 0.0)], "alone": [("new", 50, 1.0, 1.0)],
    }.items() for v, n, mean, var in cells]
    per = spark.createDataFrame(rows, "variant string, metric string, n long, mean double, var double")
    got = {r.metric: r for r in X.analysed(per, "control", target=0.1).collect()}
    first = {m: r.advice.split(".")[0] for m, r in got.items()}
    assert first == {"better": "Strong evidence favoring treatment", "small": "Statistically significant but effect size too small", "worse": "Statistically significant but effect size too small", "none": "No statistically significant difference detected", "few": "Insufficient data for analysis", "flat": "No statistically significant difference detected"}
    down = {r.metric: r for r in X.analysed(per, "control", target=0.1, higher_is_better=False).collect()}
    assert down["worse"].practical and down["worse"].advice.startswith("Strong") and not down["better"].practical
    b = got["none"]
    assert (b.df, b.t, b.p) == (38, pytest.approx(0.1 / math.sqrt(0.1)), pytest.approx(plain_tail(0.1 / math.sqrt(0.1), 38)))
    assert (b.ci_lower, b.ci_upper) == (pytest.approx(0.1 - 2.024394164 * math.sqrt(0.1)), pytest.approx(0.1 + 2.024394164 * math.sqrt(0.1)))
    assert (got["few"].p, got["few"].difference, got["few"].ci_upper, got["few"].t) == (1.0, 0.0, 0.0, None) and (got["flat"].p, got["flat"].t) == (1.0, None)


def test_p_values_by_degrees(spark):
    out = X.significance(spark.createDataFrame([(2.0, 5), (2.0, 10_000_000)], "t double, df long"))
    assert [r.p for r in out.orderBy("df").collect()] == [pytest.approx(0.101939, abs=1e-6), pytest.approx(0.0455, abs=1e-5)]

"""Trends and correlations become patterns with a rank and advice."""

import datetime as dt

from loam.operators import metrics as Q


def test_patterns_are_ranked_with_their_advice(spark):
    rows, at = [], dt.datetime(2024, 1, 1)
    for i in range(20):  # latency rises by 2 a step; throughput is flat, and errors go with it in one window
        rows.append((i, at + dt.timedelta(seconds=i), "read", "latency", 5.0 + 2 * i))
        rows.append((100 + i, at + dt.timedelta(seconds=i), "read", "error_rate", 1.0 + i % 2))
        rows.append((200 + i, at + dt.timedelta(seconds=i), "write", "throughput", 7.0))
    df = spark.createDataFrame(rows, "event_id int, ts timestamp, operation string, metric_type string, value double")
    got = {r.pattern: r for r in Q.patterns(df).collect()}
    trend = got["trend_read_latency_increasing"]
    assert (trend.rank, round(trend.impact, 6), round(trend.confidence, 6), trend.seen) == (1, 2.0, 1.0, 1)
    assert "bottleneck" in trend.advice
    assert set(got) == {"trend_read_latency_increasing"}  # a flat line and an alternating one are none
    assert Q.patterns(df, confidence=1.1).count() == 0
    assert Q.patterns(df.where("false")).count() == 0


def test_a_correlation_grows_with_its_windows(spark):
    rows, at = [], dt.datetime(2024, 1, 1)
    for w in range(3):
        for i in range(6):
            ts = at + dt.timedelta(minutes=5 * w, seconds=i)
            up = (i * 7 + w * 3) % 5
            rows += [(100 * w + 2 * i, ts, f"op{i}", "latency", float(up)), (100 * w + 2 * i + 1, ts, f"op{i}", "error_rate", 3.0 * up + 1)]
    df = spark.createDataFrame(rows, "event_id int, ts timestamp, operation string, metric_type string, value double")
    (only,) = Q.patterns(df).collect()
    assert (only.pattern, only.direction, only.seen, round(only.confidence, 6), round(only.impact, 6)) == ("correlation_error_rate_latency", "increasing", 3, 0.9, 1.0)
    assert "timeouts" in only.advice and only.first_seen == at
    assert Q.patterns(df, window="1 minute").count() == 1
    assert Q.patterns(df.where("event_id < 9")).count() == 0  # too few events in the window


def test_constant_values_have_no_correlation(spark):
    ts = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, ts, "op", m, 1.0 if m == "latency" else float(i)) for i in range(8) for m in ("latency", "error_rate")], "event_id int, ts timestamp, operation string, metric_type string, value double")
    assert Q.correlations(df).count() == 0

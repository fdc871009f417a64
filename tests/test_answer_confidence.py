"""Confidence of answers against a plain computation, with strong and weak evidence, many claims and null texts."""

import math

from loam.operators import retrieval as R


def curve(s, r):
    return 1 / (1 + math.exp(-10 * (0.7 * s + 0.3 * r - 0.5)))


def test_evidence_scores(spark):
    rows = [(1, 0, 0, "a b", "a b c", 1.0, "a z"), (1, 0, 1, "a b", None, 0.5, None), (1, 0, 2, "a b", "b " + "x" * 1000, 0.4, "b")]
    df = spark.createDataFrame(rows, "conv_id int, claim_no int, id int, claim string, text string, similarity double, asked string")
    got = {r.id: r for r in R.scored_evidence(df, "asked").collect()}
    assert round(got[0].relevance, 9) == 1.0 and math.isclose(got[0].confidence, curve(1, 1))
    assert math.isclose(got[1].relevance, 0.5) and math.isclose(got[1].confidence, curve(0.5, 0.5))
    assert math.isclose(got[2].relevance, 0.95 * (0.4 + 0.1 * 0.5 + 0.05 * 1))


def test_answers(spark):
    rows = [(1, c, i, 0.9 if i else 0.1, 0.95 if i else 0.05) for c in range(3) for i in range(2)]  # strong and weak by turns
    rows += [(2, c, 0, 0.5, 0.5) for c in range(8)]  # many claims
    rows += [(3, 0, 0, 1.0, 0.99)]
    df = spark.createDataFrame(rows, "conv_id int, claim_no int, id int, similarity double, confidence double")
    got = {r.conv_id: r for r in R.answer_confidence(df, "conv_id").collect()}
    assert (got[1].n_claims, got[1].n_strong, got[1].confidence) == (3, 3, round((0.5 + 0.15) * 0.95, 6))
    assert (got[2].n_claims, got[2].n_strong, got[2].spread, got[2].confidence) == (8, 0, 0.0, round(0.5 * 0.94, 6))
    assert got[3].confidence == 1.0
    assert R.answer_confidence(df.where("false"), "conv_id").count() == 0

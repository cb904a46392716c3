import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logrung.functions import severity as sev


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_normalize_and_rank(spark):
    for label, name, rank in [
        ("warning", "WARN", 3), ("CRITICAL", "FATAL", 5), (" error ", "ERROR", 4),
        ("nonsense", "INFO", 2), ("TRACE", "TRACE", 0), ("ERR", "INFO", 2), ("UNKNOWN", "INFO", 2),
    ]:
        assert one(spark, sev.normalize_severity(F.lit(label))) == name
        assert one(spark, sev.severity_rank(F.lit(label))) == rank
    assert sev.DEFAULT_SCALE.span == 5
    assert one(spark, sev.severity_distance(F.lit("INFO"), F.lit("ERROR"))) == 2
    assert one(spark, sev.severity_distance(F.lit("ERROR"), F.lit("INFO"))) == 2


def test_direction_and_critical(spark):
    direction = lambda a, b: one(spark, sev.mismatch_direction(F.lit(a), F.lit(b)))
    assert direction("INFO", "INFO") == "match"
    assert direction("ERROR", "INFO") == "under_prediction"
    assert direction("INFO", "ERROR") == "over_prediction"
    assert one(spark, sev.is_critical(F.lit("ERROR"))) is True
    assert one(spark, sev.is_critical(F.lit("INFO"))) is False
    assert one(spark, sev.is_critical_miss(F.lit("ERROR"), F.lit("WARN"))) is True
    assert one(spark, sev.is_critical_miss(F.lit("FATAL"), F.lit("ERROR"))) is True
    assert one(spark, sev.is_critical_miss(F.lit("INFO"), F.lit("DEBUG"))) is False


def pairs(spark, rows):
    return spark.createDataFrame(rows, "observed string, predicted string, confidence double")


def test_score(spark):
    rows = pairs(spark, [("INFO", "INFO", 100.0), ("ERROR", "INFO", 100.0), ("INFO", "ERROR", 50.0)])
    same, under, over = sev.score_mismatch(rows).collect()
    assert (same.severity_distance, same.anomaly_score, same.is_anomaly) == (0, 0.0, False)
    assert (under.mismatch_direction, under.risk_weight, under.anomaly_score) == ("under_prediction", 1.5, 60.0)
    assert under.is_anomaly is True and under.anomaly_threshold == 20.0
    assert (over.mismatch_direction, over.risk_weight) == ("over_prediction", 1.0)
    relaxed = sev.apply_threshold(sev.score_mismatch(rows), F.lit(100.0)).collect()[1]
    assert relaxed.anomaly_threshold == 100.0 and relaxed.is_anomaly is False


def test_custom_scale(spark):
    scale = sev.Scale(("LOW", "INFO", "ERROR"), {"HIGH": "ERROR"})
    row = sev.score_mismatch(pairs(spark, [("high", "low", 80.0)]), scale=scale).first()
    assert (row.severity_distance, row.anomaly_score) == (2, 120.0)
    single = sev.Scale(("INFO",), {"X": "INFO"})
    row = sev.score_mismatch(pairs(spark, [("x", "INFO", 80.0)]), scale=single).first()
    assert (row.severity_distance, row.anomaly_score, row.is_anomaly) == (0, 0.0, False)


def test_scale_without_fallback_raises(spark):
    scale = sev.Scale(("LOW", "ERROR"), {"HIGH": "ERROR"})
    with pytest.raises(Exception, match="fall back"):
        sev.score_mismatch(pairs(spark, [("other", "LOW", 1.0)]), scale=scale).collect()


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(sev.DEFAULT_ORDER), st.sampled_from(sev.DEFAULT_ORDER), st.floats(0, 100)), min_size=1, max_size=30))
def test_zero_only_without_distance_or_confidence(spark, rows):
    for r in sev.score_mismatch(pairs(spark, rows)).collect():
        assert (r.anomaly_score == 0) == (r.severity_distance == 0 or r.confidence * r.severity_distance / 5 == 0)
        assert not (r.is_anomaly and r.severity_distance == 0)

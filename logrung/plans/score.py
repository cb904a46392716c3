"""Scoring jobs without calibration; the same columns serve batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logrung.functions.masking import with_masked
from logrung.functions.parsing import parse_lines
from logrung.functions.severity import score_mismatch
from logrung.operators.classify import Scorer
from logrung.sources.records import confidence_problem, read_requests

RESPONSE_COLUMNS = [
    "observed_label", "raw_line", "predicted_label", "confidence", "mismatch_direction",
    "mismatch_distance", "anomaly_score", "anomaly_threshold", "is_anomaly", "metadata",
]


def parse_requests(requests: DataFrame) -> DataFrame:
    """Valid requests with parsed level and masked message."""
    rows = read_requests(requests).filter(F.col("reject_reason").isNull()).drop("reject_reason")
    rows = rows.withColumn("_detected", F.col("metadata.detected_level"))
    parsed = parse_lines(rows, "raw_line", "_detected").drop("_detected")
    return with_masked(parsed, "message", "_masked").withColumn("message", F.col("_masked")).drop("_masked")


def refused_requests(requests: DataFrame) -> DataFrame:
    return read_requests(requests).filter(F.col("reject_reason").isNotNull())


def response(predicted: DataFrame, *keep: str, **settings) -> DataFrame:
    """Response rows from line_level, predicted_label and confidence.

    The observed level enters as parsed, without resolving aliases first.
    """
    scored = score_mismatch(predicted, "line_level", "predicted_label", "confidence", **settings)
    return scored.select(
        *keep,
        F.col("observed_severity").alias("observed_label"),
        "raw_line",
        F.col("predicted_severity").alias("predicted_label"),
        F.round("confidence", 4).alias("confidence"),
        "mismatch_direction",
        F.col("severity_distance").alias("mismatch_distance"),
        F.round("anomaly_score", 4).alias("anomaly_score"),
        F.round("anomaly_threshold", 4).alias("anomaly_threshold"),
        "is_anomaly",
        "metadata",
    )


def score_requests(requests: DataFrame, scorer: Scorer, *keep: str, **settings) -> DataFrame:
    """Requests in, responses out; an empty batch gives an empty table."""
    return response(scorer(parse_requests(requests)), *keep, **settings)


def score_line(spark, line: str, scorer: Scorer) -> DataFrame:
    """Label and confidence of a single line (a one-row batch)."""
    one = spark.createDataFrame([(line,)], "raw_line string")
    masked = with_masked(parse_lines(one, "raw_line"), "message", "_masked")
    rows = masked.withColumn("message", F.col("_masked")).drop("_masked")
    return scorer(rows).select("raw_line", "message", "line_level", "predicted_label", "confidence")


def score_pairs(
    pairs: DataFrame, observed: str = "observed", predicted: str = "predicted", **settings
) -> DataFrame:
    """Mismatch columns for (observed, predicted, confidence) rows, no model.

    Rows whose confidence is outside 0..100 are left out. Scores stay
    unrounded.
    """
    valid = pairs.filter(confidence_problem(F.col("confidence")).isNull())
    return score_mismatch(valid, observed, predicted, "confidence", **settings)

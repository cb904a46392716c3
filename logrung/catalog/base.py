"""The query registry and what the queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logrung import fixtures
from logrung.functions.levels import canonical_level
from logrung.functions.masking import with_masked
from logrung.functions.parsing import parse_lines
from logrung.functions.severity import score_mismatch
from logrung.session import landed, scratch_path
from logrung.sources.sinks import write_text_files

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its check."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn

    return register


def parsed_logs(spark: SparkSession, sf: str) -> DataFrame:
    """(event_id, dataset, raw_line, detected_level, line_timestamp, line_level, message)."""
    lines = fixtures.logv(spark, sf).withColumnRenamed("line", "raw_line")
    return parse_lines(lines, "raw_line", "detected_level")


def masked_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed logs with ``masked``."""
    return with_masked(parsed_logs(spark, sf), "message", "masked")


def scored_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(event_id, true_label, predicted_label, confidence) plus the mismatch columns."""
    rows = fixtures.scorev(spark, sf).select(
        "event_id",
        canonical_level(F.col("observed")).alias("true_label"),
        F.col("predicted").alias("predicted_label"),
        "confidence",
    )
    return score_mismatch(rows, "true_label", "predicted_label", "confidence")


def scored_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Scored rows joined to their masked log lines by event id."""
    logs = masked_logs(spark, sf).select(
        "event_id", "dataset", "raw_line", F.col("masked").alias("message")
    )
    raw = fixtures.table(spark, sf, "events").select("event_id", F.col("props").alias("raw_json"))
    return scored_rows(spark, sf).join(logs, "event_id").join(raw, "event_id")


def staged_logs(spark: SparkSession, sf: str) -> str:
    """Log files below a fresh shared folder: one sub-folder per dataset."""
    root = scratch_path(spark, "raw-logs")
    rows = fixtures.logv(spark, sf).select("line", F.concat("dataset", F.lit("/app")).alias("file"))
    write_text_files(rows, "line", "file", root)
    return root


def staged_records(spark: SparkSession, sf: str, per_file: int = 5000) -> str:
    """JSON array files of log records, at most ``per_file`` records each."""
    root = scratch_path(spark, "raw-records")
    logs = fixtures.logv(spark, sf)
    record = F.struct(
        F.col("line"),
        F.col("event_id").cast("string").alias("timestamp"),
        F.struct(F.col("dataset").alias("app"), "detected_level", F.lit("x").alias("other")).alias("fields"),
    )
    arrays = (
        logs.groupBy("dataset", F.expr(f"event_id div {per_file}").alias("slice"))
        .agg(F.to_json(F.collect_list(record)).alias("value"))
        .select("value", F.concat("dataset", F.lit("/part-"), F.col("slice").cast("string")).alias("file"))
    )
    write_text_files(arrays, "value", "file", root, ".json")
    return root


__all__ = [
    "CHECKS", "QUERIES", "landed", "masked_logs", "parsed_logs", "query", "scored_logs", "scored_rows",
    "staged_logs", "staged_records",
]

"""Record-shaped inputs: JSON objects, scoring requests, labelled tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logrung.functions.levels import UNKNOWN, level_name
from logrung.functions.parsing import METADATA_FIELDS, metadata_struct

REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("line", T.StringType()),
        T.StructField(
            "fields", T.StructType([T.StructField(name, T.StringType()) for name in METADATA_FIELDS])
        ),
    ]
)


def project_records(df: DataFrame, record: str) -> DataFrame:
    """Append raw_line, log_timestamp, metadata and reject_reason.

    ``record`` is a VARIANT object with line, timestamp and fields, all
    optional. A line that is present but no string sets ``reject_reason``.
    """
    item = F.col(record)
    line = F.try_variant_get(item, "$.line", "variant")
    fields = F.try_variant_get(item, "$.fields", "variant")
    return df.withColumns(
        {
            "raw_line": F.coalesce(F.try_variant_get(item, "$.line", "string"), F.lit("")),
            "log_timestamp": F.coalesce(F.try_variant_get(item, "$.timestamp", "string"), F.lit("")),
            "metadata": metadata_struct(F.coalesce(F.to_json(fields), F.lit("{}"))),
            "reject_reason": F.when(
                line.isNotNull() & (F.schema_of_variant(line) != "STRING"), "line is not a string"
            ),
        }
    )


def project_json(df: DataFrame, text: str) -> DataFrame:
    """:func:`project_records` for records given as JSON text, one per row."""
    return project_records(df.withColumn("_record", F.try_parse_json(text)), "_record").drop("_record")


def request_fields(fields: Column) -> Column:
    """Request metadata with its defaults; detected_level is ``unknown``."""
    return F.struct(
        *[
            F.coalesce(fields[name], F.lit("unknown" if name == "detected_level" else "")).alias(name)
            for name in METADATA_FIELDS
        ]
    )


def request_problem(timestamp: Column, line: Column) -> Column:
    """Why a request is refused, or null."""
    return (
        F.when(timestamp.isNull(), "timestamp is missing")
        .when(line.isNull(), "line is missing")
        .when(F.length(line) < 1, "line is empty")
    )


def confidence_problem(confidence: Column) -> Column:
    return F.when(
        confidence.isNull() | ~confidence.between(0.0, 100.0), "confidence is outside 0..100"
    )


def read_requests(df: DataFrame) -> DataFrame:
    """(timestamp, line, fields) rows to raw_line, log_timestamp, metadata, reject_reason."""
    return df.withColumns(
        {
            "raw_line": F.col("line"),
            "log_timestamp": F.col("timestamp"),
            "metadata": request_fields(F.col("fields")),
            "reject_reason": request_problem(F.col("timestamp"), F.col("line")),
        }
    )


def labelled_rows(df: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """An existing (text, label) table as evaluation rows.

    The label id is the truth, whatever a level in the text says; ids outside
    the six classes are UNKNOWN.
    """
    return df.withColumns(
        {
            "raw_line": F.col(text),
            "message": F.col(text),
            "true_label": F.coalesce(level_name(F.col(label)), F.lit(UNKNOWN)),
        }
    )

"""Continuous scoring: the batch columns over a stream.

Stateless and append-only, so no watermark is needed; each micro-batch is
scored on its own and the checkpoint tracks which input was read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from logrung.operators.classify import Scorer
from logrung.plans.score import score_pairs, score_requests
from logrung.sources.records import REQUEST_SCHEMA


def read_request_stream(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    """Requests as JSON lines, picked up as files arrive."""
    reader = spark.readStream.schema(REQUEST_SCHEMA)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(root)


def read_line_stream(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    """Text lines as requests without timestamp metadata."""
    reader = spark.readStream
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(root).selectExpr(
        "'' AS timestamp", "value AS line", f"CAST(NULL AS {REQUEST_SCHEMA['fields'].dataType.simpleString()}) AS fields"
    )


def score_request_stream(requests: DataFrame, scorer: Scorer, **settings) -> DataFrame:
    """The response columns over a request stream."""
    return score_requests(requests, scorer, **settings)


def score_pair_stream(pairs: DataFrame, **settings) -> DataFrame:
    """The mismatch columns over a stream of (observed, predicted, confidence)."""
    return score_pairs(pairs, **settings)


def write_scores(
    scored: DataFrame, out: str, checkpoint: str, available_now: bool = False, interval: str = "10 seconds"
) -> StreamingQuery:
    """Start the query: parquet files, exactly once per checkpoint."""
    writer = scored.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start(out)

"""Exports and saved state."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logrung.functions.levels import UNKNOWN
from logrung.functions.text import single_line
from logrung.operators.metrics import is_known, is_wrong
from logrung.session import hadoop_path


def write_text_files(rows: DataFrame, value: str, file: str, root: str, suffix: str = ".log") -> list[str]:
    """Write text files named by a column: ``root/<file>[-n]<suffix>``.

    ``file`` may hold slashes. Rows of one file stay in the order of their
    partition. The rows are written in parallel under a hidden folder; only
    the finished files are then renamed into place, one call per file.
    """
    spark = rows.sparkSession
    staging = f"{root.rstrip('/')}/.staging-{uuid.uuid4().hex}"
    rows.select(F.col(value).alias("value"), F.col(file).alias("file")).write.partitionBy("file").text(staging)
    fs, where = hadoop_path(spark, staging)
    made: dict[str, list] = {}
    for folder in fs.listStatus(where):
        key = folder.getPath().getName()
        if key.startswith("file="):
            parts = [p.getPath() for p in fs.listStatus(folder.getPath())]
            made[unquote(key[len("file="):])] = sorted(
                (p for p in parts if p.getName().startswith("part-")), key=lambda p: p.getName()
            )
    written = []
    for name, parts in sorted(made.items()):
        for i, part in enumerate(parts):
            target = f"{root.rstrip('/')}/{name}{f'-{i}' if i else ''}{suffix}"
            _, destination = hadoop_path(spark, target)
            fs.mkdirs(destination.getParent())
            if not fs.rename(part, destination):
                raise OSError(f"could not move a finished file to {target}")
            written.append(target)
    fs.delete(where, True)
    return written


def write_chunks(chunked: DataFrame, stem: str, line: str = "raw_line") -> list[str]:
    """Write ``<stem>_001.log``, ``<stem>_002.log``, ... in shuffled order.

    ``chunked`` comes from ``sampling.assign_chunks``. A trailing ``.log`` on
    the stem is dropped, each record stays one line, nothing is written when
    there are no rows. Returns the files.
    """
    if stem.lower().endswith(".log"):
        stem = stem[: -len(".log")]
    root, _, name = stem.rpartition("/")
    ordered = (
        chunked.select(
            single_line(F.col(line)).alias("value"),
            F.concat(F.lit(f"{name}_"), "chunk").alias("file"),
            "position",
        )
        .repartition("file")
        .sortWithinPartitions("file", "position")
    )
    return write_text_files(ordered, "value", "file", root or ".")


def auto_labeled(scored: DataFrame) -> DataFrame:
    """Rows of unknown level with the predicted label, for later training."""
    return scored.filter(F.col("true_label") == UNKNOWN).select(
        F.col("raw_line").alias("text"),
        F.col("message").alias("masked_text"),
        "raw_json",
        F.col("predicted_label").alias("label"),
        F.round("confidence", 4).alias("confidence"),
    )


def incorrect_predictions(scored: DataFrame) -> DataFrame:
    """Wrong predictions of known rows, with the mismatch columns."""
    return scored.filter(is_wrong()).select(
        "true_label",
        "predicted_label",
        F.round("confidence", 4).alias("confidence"),
        "mismatch_direction",
        F.col("severity_distance").alias("mismatch_distance"),
        F.round("anomaly_score", 4).alias("anomaly_score"),
        F.round("anomaly_threshold", 4).alias("anomaly_threshold"),
        "is_anomaly",
        F.col("raw_line").alias("raw_text"),
        F.col("message").alias("masked_text_seen_by_model"),
        "raw_json",
    )


def prediction_partitions(scored: DataFrame) -> DataFrame:
    """(part, n): rows of unknown level, wrong rows and right rows."""
    part = F.when(~is_known(), "unknown").when(is_wrong(), "wrong").otherwise("right")
    return scored.groupBy(part.alias("part")).agg(F.count("*").alias("n"))


def write_json(df: DataFrame, out: str) -> None:
    df.write.mode("overwrite").json(out)


def write_run_metrics(metrics: DataFrame, out: str) -> None:
    """Append a run's long metric table, one folder per model."""
    metrics.write.mode("append").partitionBy("model").parquet(out)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_templates(templates: DataFrame, path: str) -> None:
    templates.write.mode("overwrite").parquet(path)


def load_templates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

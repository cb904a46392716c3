"""Evaluation job: sample, mask, score, calibrate, report, export."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logrung.functions.levels import canonical_level
from logrung.functions.masking import with_masked
from logrung.functions.parsing import parse_lines
from logrung.functions.severity import THRESHOLD, score_mismatch
from logrung.operators import metrics
from logrung.operators.classify import Scorer
from logrung.operators.sampling import SPLIT_SEED, display_sample, uniform_sample
from logrung.session import landed
from logrung.sources.sinks import auto_labeled, incorrect_predictions, write_json, write_run_metrics

# Display sizes.
SHOWN_INPUTS = 30
SHOWN_ERRORS = 10


@dataclass(frozen=True)
class Evaluation:
    run_id: str
    scored: DataFrame
    metrics: DataFrame


def score_rows(
    rows: DataFrame, scorer: Scorer, calibrator: metrics.Calibrator | None = None, **scoring
) -> DataFrame:
    """Predict, score the mismatch and calibrate; written once for the reports.

    ``rows`` has message (masked) and true_label. ``scoring`` holds settings of
    :func:`score_mismatch`: weights, scale, threshold.
    """
    predicted = scorer(rows)
    mismatch = score_mismatch(predicted, "true_label", "predicted_label", "confidence", **scoring)
    scored = landed(mismatch, "scored")
    chosen = calibrator or metrics.percentile_calibrator(empty=scoring.get("threshold", THRESHOLD))
    return metrics.recalibrate(scored, chosen)


def _long(df: DataFrame, label: Column, *names: str) -> DataFrame:
    cells = F.array(
        *[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]
    )
    return df.select(label.cast("string").alias("label"), F.inline(cells))


def report(scored: DataFrame, run_id: str, model: str, row_id: str | None = None) -> DataFrame:
    """All metrics of a run in one long table (run_id, model, metric, label, value)."""
    miss = metrics.critical_miss_flag()
    none = F.lit("")
    parts = [
        _long(metrics.accuracy(scored), none, "total", "known", "correct", "accuracy", "mean_confidence"),
        _long(metrics.confidence_means(scored), none, "mean_all", "mean_correct", "mean_wrong"),
        _long(metrics.classification_report(scored), F.col("label"), "precision", "recall", "f1", "support"),
        _long(metrics.per_class(scored), F.col("label"), "recall_pct", "precision_pct", "mean_confidence"),
        _long(
            metrics.unknown_distribution(scored).withColumnRenamed("n", "unknown_rows"),
            F.col("predicted_label"),
            "unknown_rows",
        ),
        _long(
            metrics.direction_counts(scored).withColumnRenamed("n", "direction_rows"),
            F.col("mismatch_direction"),
            "direction_rows",
        ),
        _long(metrics.anomaly_rate(scored), none, "flagged", "rate_pct"),
        _long(scored.agg(F.max("anomaly_threshold").alias("threshold")), none, "threshold"),
        _long(metrics.critical_miss_count(scored), none, "critical_misses"),
        _long(metrics.ranking_quality(scored, miss), none, "auroc", "auprc"),
    ]
    if row_id is not None:
        parts.append(_long(metrics.precision_at_k(scored, miss, row_id), none, "precision_at_k"))
    table = reduce(DataFrame.unionByName, parts)
    return table.select(
        F.lit(run_id).alias("run_id"), F.lit(model).alias("model"), "metric", "label", "value"
    )


def evaluate_rows(
    rows: DataFrame,
    scorer: Scorer,
    model: str,
    row_id: str | None = None,
    out: str | None = None,
    calibrator: metrics.Calibrator | None = None,
    **scoring,
) -> Evaluation:
    """Score rows that are masked and labelled already, report and export.

    With ``out`` the two exports and the metrics go below ``out/<model>``.
    """
    run_id = f"{model}_{datetime.now(timezone.utc):%Y%m%d_%H%M%S}"
    scored = score_rows(rows, scorer, calibrator, **scoring)
    table = report(scored, run_id, model, row_id)
    if out is not None:
        write_json(auto_labeled(scored), f"{out}/{model}/{run_id}_auto_labeled_logs")
        write_json(incorrect_predictions(scored), f"{out}/{model}/{run_id}_incorrect_predictions")
        write_run_metrics(table, f"{out}/metrics")
    return Evaluation(run_id, scored, table)


def evaluate_models(
    rows: DataFrame,
    scorers: dict[str, Scorer],
    ids: Sequence[str],
    row_id: str | None = None,
    detected: str | None = None,
    sample_rows: int | None = None,
    seed: int = SPLIT_SEED,
    out: str | None = None,
    calibrator: metrics.Calibrator | None = None,
    **scoring,
) -> dict[str, Evaluation]:
    """Evaluate several models on a raw corpus, or on one sample of it.

    ``rows`` has raw_line, and the metadata level in ``detected``. With
    ``sample_rows`` a sample is drawn first, so that only its rows are parsed
    and masked; by default all rows are. ``calibrator`` and ``scoring`` (weights,
    scale, threshold) are those of :func:`score_rows`.
    """
    if row_id is None and {"file_path", "pos"} <= set(rows.columns):
        # Rows of a file scan: ties in the score are ordered by a hash of file and line.
        row_id = "row_id"
        rows = rows.withColumn(row_id, F.xxhash64("file_path", "pos"))
    drawn = rows if sample_rows is None else uniform_sample(landed(rows, "corpus-rows"), sample_rows, ids, seed)
    sample = parse_lines(drawn, "raw_line", detected)
    masked = with_masked(sample, "message", "_masked")
    chosen = masked.withColumn("message", F.col("_masked")).withColumn(
        "true_label", canonical_level(F.col("line_level"))
    )
    chosen = landed(chosen.drop("_masked"), "evaluation-rows")
    return {
        name: evaluate_rows(chosen, scorer, name, row_id, out, calibrator, **scoring) for name, scorer in scorers.items()
    }


def sample_inputs(rows: DataFrame, ids: Sequence[str], n: int = SHOWN_INPUTS) -> DataFrame:
    """A few model inputs to look at."""
    return display_sample(rows, n, ids).select(*ids, "message")


def error_sample(scored: DataFrame, ids: Sequence[str], n: int = SHOWN_ERRORS) -> DataFrame:
    """A few wrong predictions to look at."""
    return display_sample(scored.filter(metrics.is_wrong()), n, ids)

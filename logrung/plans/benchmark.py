"""Model comparison on one sample of unmasked messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logrung.functions.levels import UNKNOWN
from logrung.operators.classify import Scorer
from logrung.operators.metrics import model_accuracy
from logrung.operators.sampling import SPLIT_SEED, uniform_sample
from logrung.session import landed

def benchmark_rows(parsed: DataFrame, ids: Sequence[str], n: int | None = None, seed: int = SPLIT_SEED) -> DataFrame:
    """Rows whose upper-cased raw level is not UNKNOWN, all of them or a sample of ``n``."""
    valid = parsed.withColumn("true_label", F.upper("line_level")).filter(F.col("true_label") != UNKNOWN)
    rows = valid.select(*ids, "message", "true_label")
    return rows if n is None else uniform_sample(landed(rows, "valid-rows"), n, ids, seed)


def benchmark_models(
    parsed: DataFrame, scorers: dict[str, Scorer], ids: Sequence[str], n: int | None = None, seed: int = SPLIT_SEED
) -> DataFrame:
    """(model, rows, accuracy_pct), every model on exactly the same rows."""
    rows = landed(benchmark_rows(parsed, ids, n, seed), "benchmark-rows")
    columns = {}
    for i, (name, scorer) in enumerate(scorers.items()):
        guess = f"_guess_{i}"
        rows = scorer(rows).withColumn(guess, F.col("predicted_label")).drop("predicted_label", "confidence")
        columns[name] = guess
    return model_accuracy(rows, columns)

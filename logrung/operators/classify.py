"""Severity classifier: training, model choice and scoring.

The model is multinomial logistic regression on hashed, idf-weighted tokens of
the masked text, with balanced class weights; the noise-tolerant variant refits
it under the generalised cross entropy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import ElementwiseProduct, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from logrung.functions.levels import UNKNOWN, level_name, literal_map
from logrung.functions.vectors import GCE_Q, PROBABILITY_FLOOR, argmax, gce_loss, softmax
from logrung.operators.metrics import class_weights, macro_f1, weighted_loss
from logrung.operators.tokens import tokenizer
from logrung.session import landed

WCE, GCE = "weighted_ce", "gce"

#: A fit counts equal rows together, but no more of them in one than this part of all rows.
FIT_PARTS = 1 << 17
#: Rows of a task that fits.
FIT_TASK_ROWS = 1 << 18

Scorer = Callable[[DataFrame], DataFrame]
LogitFactory = Callable[[], Callable[[list[str]], np.ndarray]]


def _features(counted: DataFrame, text: str, buckets: int) -> PipelineModel:
    """Hashed tokens times log((rows + 1) / (rows with the bucket + 1)); ``counted`` has the text and ``_n``, its rows."""
    words = tokenizer(text, "_words")
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=buckets)
    seen = HashingTF(inputCol="_words", outputCol="_seen", numFeatures=buckets, binary=True)
    hashed = seen.transform(words.transform(counted))
    # One number for each bucket comes to the driver.
    found = hashed.agg(
        Summarizer.metrics("sum").summary(F.col("_seen"), F.col("_n").cast("double")).alias("s"), F.sum("_n").alias("rows")
    ).select("s.sum", "rows").first()
    if found["rows"] is None:
        raise ValueError("no rows to train on")
    idf = Vectors.dense(np.log((found["rows"] + 1.0) / (found["sum"].toArray() + 1.0)))
    weighed = ElementwiseProduct(inputCol="_counts", outputCol="_features", scalingVec=idf)
    return PipelineModel(stages=[words, counts, weighed])


def _fit_rows(counted: DataFrame, parts: int) -> DataFrame:
    """``counted`` with ``_rows`` in place of ``_n``: rows that stand for at most 1 / ``parts`` of all each.

    Up to ``parts`` rows stay single. Above, there are never more than ``parts``
    and one for each distinct row, and each is so light that the classifier's
    standard deviations, whose weights are not counts, come out as those of
    single rows.
    """
    spark = counted.sparkSession
    total = counted.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct")).first()
    size = max(1, -(-total["rows"] // parts))
    tasks = max(spark.sparkContext.defaultParallelism, -(-(total["distinct"] + parts) // FIT_TASK_ROWS))
    starts = F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(size).cast("long"))
    apart = counted.withColumn("_start", F.explode(starts))
    apart = apart.withColumn("_rows", F.least(F.lit(size), F.col("_n") - F.col("_start")).cast("double"))
    # One very frequent text is many such rows: they are dealt anew.
    return apart.drop("_n", "_start").repartition(tasks)


def weight_of(labelled: DataFrame, label: str = "label", rows: str | None = None) -> Column:
    """Class weight by label as a literal map (one entry per class)."""
    weights = {r["label"]: r["weight"] for r in class_weights(labelled, label, rows=rows).collect()}
    return F.element_at(literal_map(weights), F.col(label).cast("int"))


def _target_probability(label: str) -> Column:
    return F.element_at(vector_to_array(F.col("_probability")), F.col(label).cast("int") + 1)


def _fit(rows: DataFrame, label: str, weight: str, max_iter: int, reg: float):
    return LogisticRegression(
        featuresCol="_features",
        labelCol=label,
        weightCol=weight,
        predictionCol="_prediction",
        probabilityCol="_probability",
        rawPredictionCol="_raw",
        family="multinomial",
        maxIter=max_iter,
        regParam=reg,
    ).fit(rows)


def train_severity(
    train: DataFrame,
    text: str = "text",
    label: str = "label",
    loss: str = WCE,
    q: float = GCE_Q,
    rounds: int = 3,
    buckets: int = 1 << 14,
    max_iter: int = 30,
    reg: float = 1e-3,
    parts: int = FIT_PARTS,
) -> PipelineModel:
    """Fit the classifier on masked text; equal rows are counted and fitted together.

    ``loss='gce'`` starts from the cross-entropy fit and re-weights rows by
    p**q of their own class: the gradient of the generalised cross entropy is
    that of the cross entropy times p**q. Of all rounds the one with the least
    loss is kept.
    """
    if loss not in (WCE, GCE):
        raise ValueError(f"unknown loss {loss!r}")
    counted = landed(train.groupBy(text, label).agg(F.count("*").alias("_n")), "fit-rows")
    features = _features(counted, text, buckets)
    rows = features.transform(_fit_rows(counted, parts)).select(
        "_features",
        F.col(label).cast("double").alias(label),
        (weight_of(counted, label, "_n") * F.col("_rows")).alias("_class_weight"),
    )
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = _fit(rows, label, "_class_weight", max_iter, reg)
        if loss == GCE:
            best, best_loss = model, _gce_of(model, rows, label, q)
            for _ in range(rounds):
                p = F.greatest(_target_probability(label), F.lit(PROBABILITY_FLOOR))
                trusted = model.transform(rows).select(
                    "_features", label, "_class_weight",
                    (F.col("_class_weight") * F.pow(p, F.lit(q))).alias("_trust"),
                )
                model = _fit(trusted, label, "_trust", max_iter, reg)
                found = _gce_of(model, rows, label, q)
                if found < best_loss:
                    best, best_loss = model, found
            model = best
    finally:
        rows.unpersist()
    return PipelineModel(stages=[*features.stages, model])


def _gce_of(model, rows: DataFrame, label: str, q: float) -> float:
    scored = model.transform(rows).select(
        "_class_weight", gce_loss(_target_probability(label), q).alias("_loss")
    )
    return weighted_loss(scored, "_loss", "_class_weight").first()["loss"]


def target_losses(model: PipelineModel, labelled: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """(label, p): probability each row's own class received."""
    scored = model.transform(labelled.withColumn("text", F.col(text)))
    return scored.select(label, _target_probability(label).alias("p"))


def score_batch(model: PipelineModel, df: DataFrame, text: str = "message") -> DataFrame:
    """Append predicted_label and confidence (0..100) by the fitted model."""
    source = model.stages[0].getInputCol()
    rows = df if source == text else df.withColumn(source, F.col(text))
    added = ["_words", "_counts", "_features", "_raw", "_probability", "_prediction"]
    scored = model.transform(rows).withColumns(
        {
            "predicted_label": level_name(F.col("_prediction"), UNKNOWN),
            "confidence": F.array_max(vector_to_array(F.col("_probability"))) * 100,
        }
    )
    if source != text and source not in df.columns:
        added.append(source)
    return scored.drop(*added)


def model_scorer(model: PipelineModel, text: str = "message") -> Scorer:
    return lambda df: score_batch(model, df, text)


def label_from_logits(df: DataFrame, logits: str = "logits", numbered: bool = False) -> DataFrame:
    """Append predicted_label and confidence from an array of logits.

    A class outside the six is UNKNOWN, or CLASS_ID_<n> when ``numbered``.
    """
    p = df.withColumn("_p", softmax(F.col(logits))).withColumn("_class", argmax(F.col("_p")))
    other = F.concat(F.lit("CLASS_ID_"), "_class") if numbered else F.lit(UNKNOWN)
    return p.withColumns(
        {
            "predicted_label": F.coalesce(level_name(F.col("_class")), other),
            "confidence": F.array_max("_p") * 100,
        }
    ).drop("_p", "_class")


def external_scorer(factory: LogitFactory, text: str = "message") -> Scorer:
    """Scorer for a model of the user's own.

    ``factory`` runs once per task and returns a function from a list of
    texts to a (rows, classes) array of logits. Batch size follows
    ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = factory()
        for texts in batches:
            found = np.asarray(predict(texts.tolist()), dtype=float)
            yield pd.Series(list(found), index=texts.index, dtype=object)

    # Only the texts travel to Python; not deterministic, so that no later filter has the model run twice.
    logits = score.asNondeterministic()

    def run(df: DataFrame) -> DataFrame:
        with_logits = df.withColumn("_logits", logits(F.col(text)))
        return label_from_logits(with_logits, "_logits").select(*df.columns, "predicted_label", "confidence")

    return run


def evaluate_labels(model: PipelineModel, labelled: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """One row (accuracy, macro_f1) on a labelled table."""
    scored = score_batch(model, labelled, text).withColumn(
        "true_label", F.coalesce(level_name(F.col(label)), F.lit(UNKNOWN))
    )
    return macro_f1(scored)


def select_best(
    train: DataFrame, validation: DataFrame, grid: Iterable[dict], **fixed
) -> tuple[PipelineModel, dict, float]:
    """Fit every setting of ``grid`` and keep the best validation macro F1."""
    best = None
    for settings in grid:
        model = train_severity(train, **fixed, **settings)
        score = evaluate_labels(model, validation).first()["macro_f1"]
        if best is None or score > best[2]:
            best = (model, settings, score)
    if best is None:
        raise ValueError("the grid is empty")
    return best

"""Training job: rows, split, vocabulary, models, held-out evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logrung.functions.levels import level_id
from logrung.functions.masking import with_masked
from logrung.operators.classify import GCE, WCE, model_scorer, select_best
from logrung.operators.sampling import SPLIT_SEED, first_rows, stratified_split
from logrung.operators.tokens import token_vocabulary
from logrung.plans.evaluate import Evaluation, evaluate_rows
from logrung.session import landed
from logrung.sources.records import labelled_rows


def training_rows(
    parsed: DataFrame,
    ids: Sequence[str],
    max_rows: int | None = None,
    bucket: Sequence[str] = ("file_path", "block"),
    order: Sequence[str] = ("pos",),
) -> DataFrame:
    """(ids, text, label): masked message and class id of mapped levels.

    Unmapped levels go before the mask is computed. ``max_rows`` keeps the
    first rows in file order, counted after that filter.
    """
    rows = parsed.withColumn("label", level_id(F.col("line_level"))).filter("label IS NOT NULL")
    if max_rows is not None:
        rows = first_rows(landed(rows, "labelled-rows"), max_rows, bucket, order)
    return with_masked(rows, "message", "text").select(*ids, "text", "label")


@dataclass(frozen=True)
class Trained:
    loss: str
    model: PipelineModel
    settings: dict
    validation_macro_f1: float
    test: Evaluation


def train_models(
    rows: DataFrame,
    ids: Sequence[str],
    losses: Sequence[str] = (WCE, GCE),
    grid: Sequence[dict] = ({},),
    seed: int = SPLIT_SEED,
    **fixed,
) -> tuple[list[Trained], DataFrame, DataFrame]:
    """Train each loss on one split; returns (results, split rows, vocabulary).

    ``grid`` lists settings to choose from by validation macro F1.
    """
    rows = landed(rows, "training-rows")
    split = landed(stratified_split(rows, ids, seed=seed), "split")
    train, validation, test = (
        split.filter(F.col("split") == part) for part in ("train", "validation", "test")
    )
    vocabulary = token_vocabulary(split)
    results = []
    for loss in losses:
        model, settings, score = select_best(train, validation, grid, loss=loss, **fixed)
        held_out = labelled_rows(test).withColumn("raw_json", F.lit(None).cast("string"))
        evaluation = evaluate_rows(held_out, model_scorer(model), loss)
        results.append(Trained(loss, model, settings, score, evaluation))
    return results, split, vocabulary

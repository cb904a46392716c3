"""Quality classifier: a sparse ensemble of rules.

Shallow boosted trees over text statistics give conjunctive rules, one for
each node below a root. A lasso logistic regression over the rules keeps few
of them. The model is compiled into Spark column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logrung.llm.decision_list import FEATURES, LABELLED_ROWS, Condition, Rule
from logrung.llm.text_stats import fold_of, label_marks, labelled_sample, with_stats
from logrung.session import landed

N_TREES = 24
DEPTH = 3
PENALTY = 1e-3
_CUTS = 48
_LEAST_ROWS = 5


@dataclass(frozen=True)
class RuleEnsemble:
    """score = 1 / (1 + exp(-(bias + sum of the weights of rules that hold)))."""

    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, stats: str = "_stats") -> Column:
        """The score as a column expression over the statistics struct."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(stats), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def predict(self, rows: pd.DataFrame) -> np.ndarray:
        total = np.full(len(rows), self.bias)
        for rule, weight in self.rules:
            total += weight * rule.covers(rows)
        return 1 / (1 + np.exp(-total))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _split(codes: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, weight: np.ndarray):
    """The best (feature, cut number) by the second-order gain, or None."""
    total_g, total_h = gradient.sum(), weight.sum()
    parent = total_g**2 / (total_h + 1)
    best, where = 1e-6, None
    for j, edges in enumerate(cuts):
        if not len(edges):
            continue
        size = len(edges) + 1
        g = np.cumsum(np.bincount(codes[:, j], gradient, size))[:-1]
        h = np.cumsum(np.bincount(codes[:, j], weight, size))[:-1]
        n = np.cumsum(np.bincount(codes[:, j], minlength=size))[:-1]
        gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - parent
        gain[(n < _LEAST_ROWS) | (len(codes) - n < _LEAST_ROWS)] = -np.inf
        i = int(np.argmax(gain))
        if gain[i] > best:
            best, where = float(gain[i]), (j, i)
    return where


def tree_rules(rows: pd.DataFrame, y: np.ndarray, features: tuple[str, ...] = FEATURES) -> list[Rule]:
    """The paths of boosted trees, from the root to every node, each path once."""
    values = rows[list(features)].to_numpy(float)
    cuts = []
    for j in range(values.shape[1]):
        distinct = np.unique(np.quantile(values[:, j], np.linspace(0, 1, _CUTS + 2), method="nearest"))
        cuts.append((distinct[1:] + distinct[:-1]) / 2)
    codes = np.column_stack([np.searchsorted(c, values[:, j], "left") for j, c in enumerate(cuts)])
    raw = np.zeros(len(y))
    found: dict[Rule, None] = {}
    for _ in range(N_TREES):
        p = _sigmoid(raw)
        gradient, weight = y - p, p * (1 - p)
        step = np.zeros(len(y))
        level = [(np.arange(len(y)), ())]
        for depth in range(DEPTH + 1):
            below = []
            for at, path in level:
                if path:
                    found[Rule(path)] = None
                where = _split(codes[at], cuts, gradient[at], weight[at]) if depth < DEPTH else None
                if where is None:
                    step[at] = gradient[at].sum() / (weight[at].sum() + 1)
                    continue
                j, i = where
                low = codes[at, j] <= i
                cut = float(cuts[j][i])
                below.append((at[low], (*path, Condition(features[j], False, cut))))
                below.append((at[~low], (*path, Condition(features[j], True, cut))))
            level = below
        raw += 0.3 * step
        if np.abs(step).max() < 1e-4:
            break
    return list(found)


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 500) -> tuple[float, np.ndarray]:
    """(bias, weights) of an L1-penalised logistic regression, by accelerated proximal gradient."""
    n, k = x.shape
    # A bound of the curvature by power iteration.
    v = np.ones(k + 1) / np.sqrt(k + 1)
    full = np.column_stack((np.ones(n), x))
    for _ in range(20):
        v = full.T @ (full @ v)
        v /= np.linalg.norm(v)
    rate = 4 * n / max(float(v @ (full.T @ (full @ v))), 1e-9)
    w = np.zeros(k + 1)
    ahead, t = w.copy(), 1.0
    for _ in range(rounds):
        gradient = full.T @ (_sigmoid(full @ ahead) - y) / n
        new = ahead - rate * gradient
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t2 * (new - w)
        moved = np.abs(new - w).max()
        w, t = new, t2
        if moved < 1e-7:
            break
    return float(w[0]), w[1:]


def fit_rows(rows: pd.DataFrame, penalty: float = PENALTY) -> RuleEnsemble:
    """The ensemble of ``label`` 0 or 1 over statistics.

    Without rows every score is one half; with one label only, the score is
    near that label everywhere.
    """
    y = rows["label"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return RuleEnsemble(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), ())
    rules = tree_rules(rows, y)
    if not rules:
        return RuleEnsemble(float(np.log(y.mean() / (1 - y.mean()))), ())
    x = np.column_stack([r.covers(rows) for r in rules]).astype(float)
    bias, weights = lasso_logistic(x, y, penalty)
    return RuleEnsemble(bias, tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if w != 0))


def quality_scores(
    docs: DataFrame, labels: DataFrame, folds: int = 5, cut: float = 0.3, limit: int = LABELLED_ROWS
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row.

    Rows of fold 0 of ``folds`` are held out of the fit; above ``limit``
    labelled rows the fit takes a bounded sample of them. Labels, language,
    source and id are no inputs of a score. Null and empty texts score by
    statistics of 0. The statistics are taken once and written; scoring is
    row-local, so repeated rows score alike and an empty table gives no rows.
    """
    stats = landed(with_stats(docs.select("doc_id", "text")).select("doc_id", "_stats"), "ensemble-stats")
    held_out = fold_of(F.col("doc_id"), folds) == 0
    learn = stats.where(~held_out).select(F.col("doc_id").cast("long").alias("doc_id"), "_stats.*")
    usable = labels.where(fold_of(F.col("doc_id"), folds) != 0)
    model = fit_rows(labelled_sample(learn, label_marks(usable, "quality", limit)))
    score = F.least(F.greatest(model.score(), F.lit(0.0)), F.lit(1.0))
    return stats.select("doc_id", held_out.alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= cut).cast("int")
    )

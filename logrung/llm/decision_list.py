"""Learned decision lists for document quality.

Sequential covering over labelled statistics: a rule is grown one threshold
condition at a time by information gain, pruned from its end on rows held
back, and kept if it is precise there; the rows it covers leave, and the next
rule is sought. The list becomes one ordered Spark conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logrung.llm.text_stats import STATS, label_marks, labelled_sample, text_stats, with_stats
from logrung.session import landed

#: Bound of the labelled rows of a fit.
LABELLED_ROWS = 50_000
#: Statistics a rule may use: shares of the text. Counts, and means that differ from
#: language to language or with the layout, would reject clean documents of other kinds.
FEATURES = tuple(s for s in STATS if s.endswith("_share"))
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


@dataclass(frozen=True)
class Condition:
    """``feature > cut`` if ``above``, else ``feature <= cut``."""

    feature: str
    above: bool
    cut: float

    def holds(self, rows: pd.DataFrame) -> np.ndarray:
        values = rows[self.feature].to_numpy()
        return values > self.cut if self.above else values <= self.cut

    def column(self, stats: str) -> Column:
        value = F.col(f"{stats}.{self.feature}")
        return value > self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction that rejects a document."""

    conditions: tuple[Condition, ...]
    precision: float = field(default=1.0, compare=False)

    def covers(self, rows: pd.DataFrame) -> np.ndarray:
        out = np.ones(len(rows), bool)
        for c in self.conditions:
            out &= c.holds(rows)
        return out

    def column(self, stats: str) -> Column:
        out = self.conditions[0].column(stats)
        for c in self.conditions[1:]:
            out = out & c.column(stats)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _gain(p: np.ndarray, n: np.ndarray, p0: int, n0: int) -> np.ndarray:
    """Information gained on the covered bad rows when p of p0 bad and n of n0 good rows stay."""
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
    return np.where(p > 0, gain, -np.inf)


def _best_condition(rows: pd.DataFrame, bad: np.ndarray, features: tuple[str, ...]) -> tuple[float, Condition | None]:
    best, found = 1e-9, None
    p0, n0 = int(bad.sum()), int((~bad).sum())
    for name in features:
        values = rows[name].to_numpy()
        order = np.argsort(values, kind="stable")
        v, b = values[order], bad[order]
        # A cut lies between two unlike values, in their middle.
        at = np.flatnonzero(v[1:] > v[:-1])
        if not len(at):
            continue
        below_p = np.cumsum(b)[at]
        below_n = at + 1 - below_p
        for above in (False, True):
            p = p0 - below_p if above else below_p
            n = n0 - below_n if above else below_n
            gains = _gain(p.astype(float), n.astype(float), p0, n0)
            i = int(np.argmax(gains))
            if gains[i] > best:
                best = float(gains[i])
                found = Condition(name, above, float((v[at[i]] + v[at[i] + 1]) / 2))
    return best, found


def _grow(rows: pd.DataFrame, bad: np.ndarray, features: tuple[str, ...], most: int) -> list[Condition]:
    conditions: list[Condition] = []
    while len(conditions) < most and (~bad).any() and bad.any():
        _, found = _best_condition(rows, bad, features)
        if found is None:
            break
        conditions.append(found)
        inside = found.holds(rows)
        rows, bad = rows[inside], bad[inside]
    return conditions


def _prune(conditions: list[Condition], rows: pd.DataFrame, bad: np.ndarray) -> Rule | None:
    """The prefix with the best (p - n) / (p + n) on held-back rows; shorter wins ties."""
    best, rule = -2.0, None
    for k in range(1, len(conditions) + 1):
        inside = Rule(tuple(conditions[:k])).covers(rows)
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best:
            best, rule = worth, Rule(tuple(conditions[:k]), p / (p + n) if p + n else 0.0)
    return rule


def learn_rules(
    rows: pd.DataFrame,
    features: tuple[str, ...] = FEATURES,
    max_rules: int = 20,
    max_conditions: int = 4,
    min_precision: float = 0.95,
    seed: int = 3,
) -> list[Rule]:
    """An ordered list of rejecting rules from ``label`` (0 is bad) and statistics.

    Two thirds of the rows grow rules, the rest prunes them; a rule that is
    less than ``min_precision`` right on all rows still uncovered ends the
    search, so a document is rejected only on good evidence. Without both
    labels there are no rules and everything is kept.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    rules: list[Rule] = []
    while len(rules) < max_rules:
        bad = rows["label"].to_numpy() == 0
        if bad.sum() < 2 or bad.all():
            break
        grow = rng.random(len(rows)) < 2 / 3
        conditions = _grow(rows[grow], bad[grow], features, max_conditions)
        rule = _prune(conditions, rows[~grow], bad[~grow]) if conditions else None
        if rule is None:
            break
        inside = rule.covers(rows)
        right = int((inside & bad).sum())
        if not right or right < min_precision * inside.sum():
            break
        rules.append(Rule(rule.conditions, right / int(inside.sum())))
        rows = rows[~inside].reset_index(drop=True)
    return rules


def base_failed(stats: str = "_stats") -> Column:
    """Too few words, or too many words inside repeated five-word windows."""
    words, repeats = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)


def rejecting_rule(rules: list[Rule], stats: str = "_stats") -> Column:
    """The number of the first rule that fires, from 1, as one ordered conditional; null if none does."""
    if not rules:
        return F.lit(None).cast("int")
    out = F.when(rules[0].column(stats), F.lit(1))
    for i, rule in enumerate(rules[1:], 2):
        out = out.when(rule.column(stats), F.lit(i))
    return out


def fit(docs: DataFrame, labels: DataFrame, limit: int = LABELLED_ROWS) -> list[Rule]:
    """Rules from the labelled rows of ``docs``, a bounded sample of them above ``limit``.

    The ids of the sample are broadcast: they are ``limit`` at most, give or take the draw.
    """
    marks = landed(label_marks(labels, "quality", limit), "label-marks")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    some = own.join(F.broadcast(marks.select("doc_id")), "doc_id", "left_semi")
    return learn_rules(labelled_sample(with_stats(some).select("doc_id", "_stats.*"), marks))


def kept_rows(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and that no learned rule rejects.

    Null texts are empty; texts of fewer than ten words fail the base rules.
    Row-local: repeated rows are judged alike, an empty table gives no rows,
    other columns pass through whatever their names.
    """
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        text_stats(F.col("text").cast("string")).alias("_stats"),
    )
    return whole.where(~base_failed() & rejecting_rule(rules).isNull()).select("row.*")


def quality_table(docs: DataFrame, labels: DataFrame, limit: int = LABELLED_ROWS) -> DataFrame:
    """(doc_id, _stats, base_failed, rule, kept) of each row; the statistics are taken once and written.

    ``rule`` is the number of the first learned rule that fires, else null.
    """
    stats = landed(with_stats(docs.select("doc_id", "text")).select("doc_id", "_stats"), "quality-stats")
    rows = stats.select(F.col("doc_id").cast("long").alias("doc_id"), "_stats.*")
    rules = learn_rules(labelled_sample(rows, label_marks(labels, "quality", limit)))
    return stats.withColumns({"base_failed": base_failed(), "rule": rejecting_rule(rules)}).withColumn(
        "kept", ~F.col("base_failed") & F.col("rule").isNull()
    )

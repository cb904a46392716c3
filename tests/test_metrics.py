"""Metrics against brute force, with ties and hot values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logrung.operators import metrics, ranks


def table(spark, scores, hits):
    rows = [(i, float(s), int(h)) for i, (s, h) in enumerate(zip(scores, hits))]
    return spark.createDataFrame(rows, "row_id long, anomaly_score double, hit int")


def auroc(scores, hits):
    pos = [s for s, h in zip(scores, hits) if h]
    neg = [s for s, h in zip(scores, hits) if not h]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def average_precision(scores, hits):
    area, found = 0.0, 0
    for t in sorted(set(scores), reverse=True):
        above = [h for s, h in zip(scores, hits) if s >= t]
        area += (sum(above) - found) / sum(hits) * sum(above) / len(above)
        found = sum(above)
    return area


@pytest.mark.parametrize("seed,distinct", [(1, 3), (2, 40), (3, 100000)])
def test_ranking_metrics(spark, seed, distinct):
    rng = np.random.default_rng(seed)
    n = 400
    scores = rng.integers(0, distinct, n) / 7.0
    scores[: n // 3] = 0.0  # a third of all rows share one score
    hits = (rng.random(n) < 0.3).astype(int)
    df = table(spark, scores, hits)
    got = metrics.ranking_quality(df, F.col("hit") == 1).first()
    assert (got.positives, got.total) == (hits.sum(), n)
    assert got.auroc == pytest.approx(auroc(scores, hits), abs=1e-12)
    assert got.auprc == pytest.approx(average_precision(scores, hits), abs=1e-12)
    order = sorted(range(n), key=lambda i: (-scores[i], i))
    for k in (None, 1, 50, n, n + 5):
        size = int(hits.sum()) if k is None else k
        top = order[:size]
        found = metrics.precision_at_k(df, F.col("hit") == 1, "row_id", k).first()
        assert found.taken == len(top) and found.hits == hits[top].sum()
        assert found.precision_at_k == pytest.approx(hits[top].mean())


def test_ranking_edges(spark):
    df = table(spark, [1, 2, 3], [0, 0, 0])
    row = metrics.ranking_quality(df, F.col("hit") == 1).first()
    assert row.auroc is None and row.auprc is None
    assert metrics.precision_at_k(df, F.col("hit") == 1, "row_id").first().precision_at_k == 0.0
    assert metrics.precision_at_k(df, F.col("hit") == 1, "row_id", 0).first().precision_at_k == 0.0
    empty = df.filter("row_id < 0")
    assert metrics.precision_at_k(empty, F.col("hit") == 1, "row_id", 3).first().precision_at_k == 0.0
    assert metrics.ranking_quality(empty, F.col("hit") == 1).first().auroc is None


@pytest.mark.parametrize("p", [0.0, 12.5, 50.0, 95.0, 100.0])
def test_percentile_is_exact(spark, p):
    rng = np.random.default_rng(5)
    scores = np.concatenate([np.zeros(200), rng.random(401) * 90])
    df = table(spark, scores, np.zeros(len(scores)))
    got = metrics.exact_percentile(df, "anomaly_score", p).first().threshold
    assert got == pytest.approx(np.percentile(scores, p), abs=1e-9)


def test_percentile_edges(spark):
    df = table(spark, [4.0], [0])
    assert metrics.exact_percentile(df, "anomaly_score", 95.0).first().threshold == 4.0
    assert metrics.exact_percentile(df.filter("row_id < 0"), "anomaly_score", 95.0, 20.0).first().threshold == 20.0
    for bad in (-1.0, 100.5):
        with pytest.raises(ValueError):
            metrics.exact_percentile(df, "anomaly_score", bad)
    close = metrics.approximate_percentile(table(spark, range(1000), [0] * 1000), "anomaly_score", 95.0).first()
    assert abs(close.threshold - 949) <= 1


def test_running_totals_with_few_buckets(spark):
    df = spark.range(1000).select((F.col("id") * 3).alias("k"), F.lit(2).alias("n"))
    got = ranks.running_totals(df, "k", ["n"], buckets=7).orderBy("k").collect()
    assert [r.n_before for r in got] == [2 * i for i in range(1000)]
    assert {r.n_total for r in got} == {2000}


def scored(spark, rows):
    return spark.createDataFrame(rows, "true_label string, predicted_label string, confidence double")


def test_report_by_hand(spark):
    df = scored(
        spark,
        [("INFO", "INFO", 90.0), ("INFO", "WARN", 50.0), ("ERROR", "ERROR", 80.0), ("ERROR", "ERROR", 70.0), ("UNKNOWN", "INFO", 60.0)],
    )
    acc = metrics.accuracy(df).first()
    assert (acc.total, acc.known, acc.correct, acc.accuracy, acc.mean_confidence) == (5, 4, 3, 75.0, 72.5)
    means = metrics.confidence_means(df).first()
    assert (means.mean_all, means.mean_correct, means.mean_wrong) == (70.0, 80.0, 50.0)
    rep = {r.label: r for r in metrics.classification_report(df).collect()}
    assert (rep["INFO"].precision, rep["INFO"].recall, rep["INFO"].support) == (1.0, 0.5, 2)
    assert (rep["WARN"].precision, rep["WARN"].recall, rep["WARN"].f1, rep["WARN"].support) == (0.0, 0.0, 0.0, 0)
    assert rep["macro avg"].recall == pytest.approx(0.5)
    assert rep["weighted avg"].recall == pytest.approx(0.75)
    assert rep["accuracy"].f1 == 0.75
    assert {r.label for r in metrics.per_class(df).collect()} == {"INFO", "ERROR"}
    assert metrics.macro_f1(df).first().macro_f1 == pytest.approx((2 / 3 + 1 + 0) / 3)
    empty = df.filter("confidence < 0")
    assert metrics.accuracy(empty).first().accuracy == 0.0
    assert metrics.confidence_means(empty).first().mean_wrong == 0.0
    assert metrics.classification_report(empty).count() == 3


def test_class_weights(spark):
    rows = spark.createDataFrame([(2,)] * 6 + [(4,)] * 2, "label int")
    got = {r.label: r.weight for r in metrics.class_weights(rows).collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 8 / 36, 3: 0.0, 4: 8 / 12, 5: 0.0}
    assert {r.weight for r in metrics.class_weights(rows.filter("label > 9")).collect()} == {1.0}

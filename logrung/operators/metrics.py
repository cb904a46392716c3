"""Classification, confidence and anomaly metrics over a scored table.

A scored table has true_label, predicted_label and confidence, and for the
anomaly part severity_distance, mismatch_direction, anomaly_score,
anomaly_threshold and is_anomaly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logrung.functions.levels import CANONICAL_LEVELS, UNKNOWN
from logrung.functions.severity import DEFAULT_SCALE, Scale, apply_threshold, is_critical_miss
from logrung.operators.ranks import running_totals
from logrung.session import landed

PERCENTILE = 95.0

Calibrator = Callable[[DataFrame], DataFrame]


def is_known() -> Column:
    return F.col("true_label") != UNKNOWN


def is_correct() -> Column:
    return F.upper("predicted_label") == F.upper("true_label")


def is_wrong() -> Column:
    """The exports' reading of wrong: labels differ and the truth is known."""
    return (F.col("true_label") != F.col("predicted_label")) & is_known()


def _mean(value: Column, where: Column | None = None) -> Column:
    picked = value if where is None else F.when(where, value)
    return F.coalesce(F.avg(picked), F.lit(0.0))


def accuracy(scored: DataFrame) -> DataFrame:
    """Correct rows (all of them) over known rows, in percent."""
    known, correct = F.count_if(is_known()), F.count_if(is_correct())
    return scored.agg(
        F.count("*").alias("total"),
        known.alias("known"),
        correct.alias("correct"),
        F.when(known > 0, correct / known * 100).otherwise(0.0).alias("accuracy"),
        _mean(F.col("confidence"), is_known()).alias("mean_confidence"),
    )


def confidence_means(scored: DataFrame) -> DataFrame:
    """Mean confidence of all, correct, and known wrong rows."""
    c = F.col("confidence")
    return scored.agg(
        _mean(c).alias("mean_all"),
        _mean(c, is_correct()).alias("mean_correct"),
        _mean(c, ~is_correct() & is_known()).alias("mean_wrong"),
    )


def confusion(scored: DataFrame) -> DataFrame:
    """(true_label, predicted_label, n, confidence_sum) over known rows."""
    return (
        scored.filter(is_known())
        .groupBy("true_label", "predicted_label")
        .agg(F.count("*").alias("n"), F.sum("confidence").alias("confidence_sum"))
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def label_scores(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per label in truth or prediction.

    Works on confusion counts: each cell feeds its true label and its
    predicted label, and one small aggregation adds them up.
    """
    same = F.col("true_label") == F.col("predicted_label")
    n, zero = F.col("n"), F.lit(0).cast("long")
    cell = F.array(
        F.struct(
            F.col("true_label").alias("label"),
            F.when(same, n).otherwise(zero).alias("hits"),
            n.alias("support"),
            zero.alias("predicted"),
            F.col("confidence_sum").alias("confidence_sum"),
        ),
        F.struct(
            F.col("predicted_label").alias("label"),
            zero.alias("hits"),
            zero.alias("support"),
            n.alias("predicted"),
            F.lit(0.0).alias("confidence_sum"),
        ),
    )
    sums = (
        matrix.select(F.inline(cell))
        .groupBy("label")
        .agg(*[F.sum(c).alias(c) for c in ("hits", "support", "predicted", "confidence_sum")])
    )
    precision = _ratio(F.col("hits"), F.col("predicted"))
    recall = _ratio(F.col("hits"), F.col("support"))
    # 2pr / (p + r), written on the counts.
    f1 = _ratio(2 * F.col("hits"), F.col("predicted") + F.col("support"))
    return sums.select(
        "label",
        precision.alias("precision"),
        recall.alias("recall"),
        f1.alias("f1"),
        "support",
        "hits",
        "confidence_sum",
    )


def per_class(scored: DataFrame) -> DataFrame:
    """Recall, precision and mean confidence of classes present in the truth."""
    return (
        label_scores(confusion(scored))
        .filter("support > 0")
        .select(
            "label",
            (F.col("recall") * 100).alias("recall_pct"),
            (F.col("precision") * 100).alias("precision_pct"),
            (F.col("confidence_sum") / F.col("support")).alias("mean_confidence"),
            "support",
        )
    )


def classification_report(scored: DataFrame) -> DataFrame:
    """Rows per label, then accuracy, macro avg and weighted avg."""
    labels = label_scores(confusion(scored))
    rows = labels.select("label", "precision", "recall", "f1", "support")
    total = F.sum("support")
    hit_rate = _ratio(F.sum("hits"), total)
    weighted = [
        _ratio(F.sum(F.col(m) * F.col("support")), total).alias(m)
        for m in ("precision", "recall", "f1")
    ]
    means = [F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in ("precision", "recall", "f1")]
    support = F.coalesce(total, F.lit(0)).alias("support")
    acc = labels.agg(*[hit_rate.alias(m) for m in ("precision", "recall", "f1")], support)
    summary = [
        acc.withColumn("label", F.lit("accuracy")),
        labels.agg(*means, support).withColumn("label", F.lit("macro avg")),
        labels.agg(*weighted, support).withColumn("label", F.lit("weighted avg")),
    ]
    for part in summary:
        rows = rows.unionByName(part)
    return rows


def macro_f1(scored: DataFrame) -> DataFrame:
    """Accuracy and unweighted mean F1, both as shares."""
    labels = label_scores(confusion(scored))
    return labels.agg(
        _ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"),
    )


def unknown_distribution(scored: DataFrame) -> DataFrame:
    """How rows without a known level were predicted."""
    return (
        scored.filter(~is_known()).groupBy("predicted_label").agg(F.count("*").alias("n"))
    )


def class_weights(
    labelled: DataFrame, label: str = "label", classes: int = len(CANONICAL_LEVELS), rows: str | None = None
) -> DataFrame:
    """Balanced weights n / (classes * count); absent classes weigh 0.

    Without any row every class weighs 1. ``rows`` names a column of counts of
    rows that are counted already.
    """
    n = F.count("*") if rows is None else F.sum(rows)
    counts = labelled.groupBy(F.col(label).cast("int").alias("label")).agg(n.alias("n"))
    ids = labelled.sparkSession.range(classes).select(F.col("id").cast("int").alias("label"))
    # One row per class from here on.
    filled = ids.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    weight = F.when(F.col("_total") == 0, F.lit(1.0)).otherwise(
        F.coalesce(F.try_divide(F.col("_total"), F.lit(float(classes)) * F.col("n")), F.lit(0.0))
    )
    return filled.withColumn("_total", total).select("label", "n", weight.alias("weight"))


def direction_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("mismatch_direction").agg(F.count("*").alias("n")).orderBy("mismatch_direction")


def anomaly_rate(scored: DataFrame, *by: str) -> DataFrame:
    """Flagged rows and their share in percent, over all or per group."""
    flagged = F.count_if("is_anomaly")
    return scored.groupBy(*by).agg(
        F.count("*").alias("total"),
        flagged.alias("flagged"),
        F.when(F.count("*") > 0, flagged / F.count("*") * 100).otherwise(0.0).alias("rate_pct"),
    )


def critical_miss_flag(scale: Scale = DEFAULT_SCALE) -> Column:
    return is_critical_miss(F.col("observed_severity"), F.col("predicted_severity"), scale)


def critical_miss_count(scored: DataFrame, scale: Scale = DEFAULT_SCALE) -> DataFrame:
    return scored.agg(F.count_if(critical_miss_flag(scale)).alias("critical_misses"))


def exact_percentile(
    df: DataFrame, column: str, percentile: float = PERCENTILE, empty: float = 0.0
) -> DataFrame:
    """One row ``threshold``: linear-interpolation percentile, exact.

    Values are counted first, and the two neighbours of the wanted position
    are found by running totals, so no task holds all values.
    """
    if not 0.0 <= percentile <= 100.0:
        raise ValueError("percentile must lie in [0, 100]")
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    ranked = running_totals(counts, "value", ["n"])
    spot = F.lit(percentile / 100.0) * (F.col("n_total") - 1)
    low = F.floor(spot)

    def at(rank: Column) -> Column:
        return F.max(
            F.when((F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n")), F.col("value"))
        )

    pair = ranked.agg(
        at(low).alias("a"),
        at(F.least(low + 1, F.col("n_total") - 1)).alias("b"),
        F.max(spot - low).alias("t"),
    )
    value = F.col("a") + (F.col("b") - F.col("a")) * F.col("t")
    return pair.select(F.coalesce(value, F.lit(float(empty))).alias("threshold"))


def approximate_percentile(
    df: DataFrame, column: str, percentile: float = PERCENTILE, empty: float = 0.0, accuracy: int = 10_000
) -> DataFrame:
    """The opt-in one-pass form of :func:`exact_percentile`."""
    if not 0.0 <= percentile <= 100.0:
        raise ValueError("percentile must lie in [0, 100]")
    value = F.percentile_approx(column, F.lit(percentile / 100.0), accuracy)
    return df.agg(F.coalesce(value, F.lit(float(empty))).alias("threshold"))


def percentile_calibrator(percentile: float = PERCENTILE, empty: float = 0.0) -> Calibrator:
    """A calibrator: scored table in, one-row ``threshold`` table out."""
    return lambda scored: exact_percentile(scored, "anomaly_score", percentile, empty)


def recalibrate(scored: DataFrame, calibrator: Calibrator | None = None) -> DataFrame:
    """Set the calibrated threshold on every row and raise the flags again."""
    threshold = landed((calibrator or percentile_calibrator())(scored), "threshold")
    return apply_threshold(scored, threshold.select("threshold").scalar())


def _score_steps(df: DataFrame, positive: Column, score: str) -> DataFrame:
    """One row per distinct score with positive and total counts, prefixed."""
    steps = df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(positive).alias("pos"), F.count("*").alias("n")
    )
    return running_totals(steps, "score", ["pos", "n"])


def ranking_quality(df: DataFrame, positive: Column, score: str = "anomaly_score") -> DataFrame:
    """One row (positives, total, auroc, auprc); null without both classes.

    AUROC is the rank-sum form with ties counted half; AUPRC sums precision
    times the recall step over distinct scores from the top.
    """
    s = _score_steps(df, positive, score)
    pos, n = F.col("pos"), F.col("n")
    pos_total, n_total = F.col("pos_total"), F.col("n_total")
    neg = n - pos
    neg_before = F.col("n_before") - F.col("pos_before")
    at_or_above = n_total - F.col("n_before")
    hits_at_or_above = pos_total - F.col("pos_before")
    sums = s.agg(
        F.max("pos_total").alias("positives"),
        F.max("n_total").alias("total"),
        F.sum(pos * (neg_before + neg / 2.0)).alias("_wins"),
        F.sum(pos * hits_at_or_above / at_or_above).alias("_steps"),
    )
    p, t = F.col("positives"), F.col("total")
    both = (p > 0) & (p < t)
    return sums.select(
        F.coalesce(p, F.lit(0)).alias("positives"),
        F.coalesce(t, F.lit(0)).alias("total"),
        F.when(both, F.col("_wins") / (p.cast("double") * (t - p))).alias("auroc"),
        F.when(both, F.col("_steps") / p).alias("auprc"),
    )


def precision_at_k(
    df: DataFrame,
    positive: Column,
    row_id: str,
    k: int | None = None,
    score: str = "anomaly_score",
) -> DataFrame:
    """One row (k, taken, hits, precision_at_k) for the k highest scores.

    ``k`` defaults to the number of positives. Ties at the last score are
    taken in ``row_id`` order. Whole score groups are settled by counts; only
    the rows that tie at the last score are ranked, again in buckets.
    """
    steps = _score_steps(df, positive, score)
    size = F.col("pos_total") if k is None else F.lit(int(k)).cast("long")
    reach = F.col("n_total") - F.col("n_before")
    wanted = F.least(size, F.col("n_total"))
    last = (
        steps.filter((reach >= wanted) & (wanted > 0))
        .agg(
            F.max_by(
                F.struct(
                    "score",
                    wanted.alias("taken"),
                    (wanted - (reach - F.col("n"))).alias("ties_taken"),
                    (F.col("pos_total") - F.col("pos_before") - F.col("pos")).alias("hits_above"),
                ),
                "score",
            ).alias("cut")
        )
        .first()["cut"]
    )
    spark = df.sparkSession
    if last is None:
        return spark.sql(
            f"SELECT {0 if k is None else int(k)}L AS k, 0L AS taken, 0L AS hits, 0D AS precision_at_k"
        )
    ties = df.filter(F.col(score) == F.lit(last["score"])).select(
        F.col(row_id).alias("row"), F.lit(1).alias("one"), positive.cast("int").alias("hit")
    )
    tie_hits = F.coalesce(
        F.sum(F.when(F.col("one_before") < last["ties_taken"], F.col("hit"))), F.lit(0)
    )
    hits = F.lit(last["hits_above"]) + tie_hits
    taken = last["taken"]
    return running_totals(ties, "row", ["one"]).agg(
        F.lit(taken if k is None else int(k)).cast("long").alias("k"),
        F.lit(taken).cast("long").alias("taken"),
        hits.cast("long").alias("hits"),
        (hits / F.lit(float(taken))).alias("precision_at_k"),
    )


def model_accuracy(scored: DataFrame, models: dict[str, str], truth: str = "true_label") -> DataFrame:
    """(model, accuracy_pct) of several prediction columns on the same rows."""
    pairs = F.array(
        *[F.struct(F.lit(m).alias("model"), F.col(c).alias("guess")) for m, c in models.items()]
    )
    flat = scored.select(F.col(truth).alias("truth"), F.inline(pairs))
    hit = F.count_if(F.upper("guess") == F.col("truth"))
    return flat.groupBy("model").agg(
        F.count("*").alias("rows"), (hit / F.count("*") * 100).alias("accuracy_pct")
    )


def weighted_loss(rows: DataFrame, loss: str, weight: str) -> DataFrame:
    """One row ``loss``: weighted mean with the weight sum floored at 1e-8."""
    total = F.greatest(F.sum(weight), F.lit(1e-8))
    return rows.agg((F.sum(F.col(weight) * F.col(loss)) / total).alias("loss"))

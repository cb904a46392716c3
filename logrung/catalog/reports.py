"""Queries on joins, metrics and exports over scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logrung import fixtures
from logrung.catalog import sql
from logrung.catalog.base import parsed_logs, query, scored_logs, scored_rows
from logrung.functions.levels import canonical_level
from logrung.functions.severity import score_mismatch
from logrung.functions.vectors import gce_loss, label_probability, softmax
from logrung.operators import metrics
from logrung.plans.score import RESPONSE_COLUMNS, response, score_pairs
from logrung.sources.records import labelled_rows
from logrung.sources.sinks import auto_labeled, incorrect_predictions, prediction_partitions


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round for comparison; ten digits first, so that the last bits of a sum
    cannot tip a value that lies exactly between two."""
    return df.withColumns({c: F.round(F.round(c, 10), digits) for c in columns})


_KNOWN = "true_label <> 'UNKNOWN'"
_RIGHT = "upper(true_label) = upper(predicted_label)"


@query(
    "dataset_anomalies",
    f"""{sql.WITH_SCORED_LOGS}, leveled AS (SELECT s.event_id, p.dataset, {sql.canonical('p.line_level')} AS true_label,
          s.predicted_label, s.confidence FROM parsed p JOIN base s USING (event_id))
        SELECT dataset, count(*) AS total, count_if(is_anomaly) AS flagged,
          round(count_if(is_anomaly) * 1e2 / count(*), 6) AS rate_pct,
          count_if(mismatch_direction = 'match') AS matches,
          count_if(mismatch_direction = 'under_prediction') AS under_predictions,
          count_if(mismatch_direction = 'over_prediction') AS over_predictions
        FROM ({sql.mismatch('leveled', 'true_label', 'predicted_label')}) GROUP BY dataset""",
)
def _(spark, sf):
    guesses = fixtures.scorev(spark, sf).select("event_id", "predicted", "confidence")
    rows = parsed_logs(spark, sf).join(guesses, "event_id")
    scored = score_mismatch(
        rows.withColumn("true_label", canonical_level(F.col("line_level"))), "true_label", "predicted"
    )
    flagged, way = F.count_if("is_anomaly"), F.col("mismatch_direction")
    return scored.groupBy("dataset").agg(
        F.count("*").alias("total"),
        flagged.alias("flagged"),
        F.round(flagged * 100 / F.count("*"), 6).alias("rate_pct"),
        F.count_if(way == "match").alias("matches"),
        F.count_if(way == "under_prediction").alias("under_predictions"),
        F.count_if(way == "over_prediction").alias("over_predictions"),
    )


@query(
    "join_predictions",
    f"{sql.WITH_SCORED_LOGS} SELECT event_id, dataset, raw_line, true_label, predicted_label, confidence FROM scored_logs",
)
def _(spark, sf):
    return scored_logs(spark, sf).select(
        "event_id", "dataset", "raw_line", "true_label", "predicted_label", "confidence"
    )


@query(
    "eval_from_table",
    f"""SELECT doc_id, message, {sql.sev_name('x')} AS observed, known FROM (
        SELECT d.doc_id, d.text AS message, l.quality + 5 * l.toxic < 6 AS known,
          CASE WHEN l.quality + 5 * l.toxic = 0 THEN 'TRACE' WHEN l.quality + 5 * l.toxic = 1 THEN 'DEBUG'
               WHEN l.quality + 5 * l.toxic = 5 THEN 'FATAL' ELSE 'UNKNOWN' END AS x
        FROM documents d JOIN labels l USING (doc_id))""",
)
def _(spark, sf):
    labels = fixtures.table(spark, sf, "labels").withColumn("label", F.col("quality") + 5 * F.col("toxic"))
    table = fixtures.table(spark, sf, "documents").join(labels, "doc_id")
    from logrung.functions.severity import normalize_severity

    rows = labelled_rows(table)
    return rows.select(
        "doc_id",
        "message",
        normalize_severity(F.col("true_label")).alias("observed"),
        (F.col("true_label") != "UNKNOWN").alias("known"),
    )


# Requests built from events: some lack the timestamp, the line or both.
_REQUEST = """
 SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id AS {S}) END AS timestamp,
        CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN '' ELSE event_type END AS line,
        CASE WHEN event_id % 3 = 0 THEN event_type END AS app FROM {events}
"""


@query(
    "request_validate",
    f"""SELECT event_id, line AS raw_line, timestamp AS log_timestamp, coalesce(app, '') AS app, 'unknown' AS detected_level,
        CASE WHEN timestamp IS NULL THEN 'timestamp is missing' WHEN line IS NULL THEN 'line is missing'
             WHEN length(line) < 1 THEN 'line is empty' END AS reject_reason
       FROM ({_REQUEST.format(S='VARCHAR', events='events')})""",
)
def _(spark, sf):
    from logrung.functions.parsing import METADATA_FIELDS
    from logrung.sources.records import read_requests

    raw = spark.sql(_REQUEST.format(S="STRING", events="{events}"), events=fixtures.table(spark, sf, "events"))
    fields = F.struct(
        *[(F.col("app") if n == "app" else F.lit(None).cast("string")).alias(n) for n in METADATA_FIELDS]
    )
    rows = read_requests(raw.withColumn("fields", fields))
    return rows.select(
        "event_id", "raw_line", "log_timestamp", "metadata.app", "metadata.detected_level", "reject_reason"
    )


@query(
    "prediction_partitions",
    f"""{sql.WITH_SCORED} SELECT CASE WHEN NOT ({_KNOWN}) THEN 'unknown' WHEN true_label <> predicted_label THEN 'wrong' ELSE 'right' END AS part,
        count(*) AS n FROM scored GROUP BY 1""",
)
def _(spark, sf):
    return prediction_partitions(scored_rows(spark, sf))


@query(
    "bench_filter",
    f"{sql.WITH_PARSED} SELECT event_id, message, upper(line_level) AS true_label FROM parsed WHERE upper(line_level) <> 'UNKNOWN'",
)
def _(spark, sf):
    rows = parsed_logs(spark, sf).withColumn("true_label", F.upper("line_level"))
    return rows.filter("true_label <> 'UNKNOWN'").select("event_id", "message", "true_label")


@query(
    "score_response",
    f"""{sql.WITH_SCORED_LOGS}, leveled AS (SELECT p.event_id, p.raw_line, p.line_level, p.dataset, s.predicted_label, s.confidence
          FROM parsed p JOIN base s USING (event_id))
        SELECT event_id, observed_severity AS observed_label, raw_line, predicted_severity AS predicted_label,
          round(confidence, 4) AS confidence, mismatch_direction, severity_distance AS mismatch_distance,
          round(anomaly_score, 4) AS anomaly_score, round(anomaly_threshold, 4) AS anomaly_threshold, is_anomaly, dataset AS app
        FROM ({sql.mismatch('leveled', 'line_level', 'predicted_label')})""",
)
def _(spark, sf):
    guesses = fixtures.scorev(spark, sf).select("event_id", F.col("predicted").alias("predicted_label"), "confidence")
    rows = parsed_logs(spark, sf).join(guesses, "event_id")
    rows = rows.withColumn("metadata", F.struct(F.col("dataset").alias("app")))
    flat = [c for c in RESPONSE_COLUMNS if c != "metadata"]
    return response(rows, "event_id").select("event_id", *flat, "metadata.app")


@query(
    "score_pairs",
    f"""{sql.WITH_SCOREV}, valid AS (SELECT event_id, observed, predicted, confidence * 1.2e0 AS confidence FROM scorev
          WHERE confidence * 1.2e0 BETWEEN 0 AND 100)
        SELECT event_id, observed_severity, predicted_severity, mismatch_direction, severity_distance, confidence,
          anomaly_score, anomaly_threshold, is_anomaly FROM ({sql.mismatch('valid', 'observed', 'predicted')})""",
)
def _(spark, sf):
    # Some confidences end up above 100 and are refused.
    pairs = fixtures.scorev(spark, sf).withColumn("confidence", F.col("confidence") * 1.2)
    return score_pairs(pairs).drop("observed", "predicted", "risk_weight")


@query(
    "accuracy",
    f"""{sql.WITH_SCORED} SELECT count(*) AS total, count_if({_KNOWN}) AS known, count_if({_RIGHT}) AS correct,
        round(count_if({_RIGHT}) * 1e2 / count_if({_KNOWN}), 6) AS accuracy,
        round(round(avg(confidence) FILTER ({_KNOWN}), 10), 6) AS mean_confidence FROM scored""",
)
def _(spark, sf):
    return rounded(metrics.accuracy(scored_rows(spark, sf)), "accuracy", "mean_confidence")


@query(
    "confidence_means",
    f"""{sql.WITH_SCORED} SELECT round(round(avg(confidence), 10), 6) AS mean_all, round(round(avg(confidence) FILTER ({_RIGHT}), 10), 6) AS mean_correct,
        round(round(avg(confidence) FILTER (NOT ({_RIGHT}) AND {_KNOWN}), 10), 6) AS mean_wrong FROM scored""",
)
def _(spark, sf):
    return rounded(metrics.confidence_means(scored_rows(spark, sf)), "mean_all", "mean_correct", "mean_wrong")


_LABELS = f"""known AS (SELECT * FROM scored WHERE {_KNOWN}),
 names AS (SELECT true_label AS label FROM known UNION SELECT predicted_label FROM known),
 labels AS (SELECT label, count_if(true_label = label AND predicted_label = label) AS hits,
   count_if(true_label = label) AS support, count_if(predicted_label = label) AS predicted,
   avg(confidence) FILTER (true_label = label) AS mean_confidence
   FROM names CROSS JOIN known GROUP BY label),
 rates AS (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0e0 END AS precision,
   CASE WHEN support > 0 THEN hits / support ELSE 0e0 END AS recall,
   CASE WHEN predicted + support > 0 THEN 2e0 * hits / (predicted + support) ELSE 0e0 END AS f1 FROM labels)"""


@query(
    "per_class",
    f"""{sql.WITH_SCORED}, {_LABELS} SELECT label, round(recall * 100, 6) AS recall_pct, round(precision * 100, 6) AS precision_pct,
        round(round(mean_confidence, 10), 6) AS mean_confidence, support FROM rates WHERE support > 0""",
)
def _(spark, sf):
    return rounded(metrics.per_class(scored_rows(spark, sf)), "recall_pct", "precision_pct", "mean_confidence")


@query(
    "classification_report",
    f"""{sql.WITH_SCORED}, {_LABELS}, lines AS (
        SELECT label, precision, recall, f1, support FROM rates
        UNION ALL SELECT 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support), sum(hits) / sum(support), sum(support) FROM rates
        UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM rates
        UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
          sum(f1 * support) / sum(support), sum(support) FROM rates)
        SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
          CAST(support AS BIGINT) AS support FROM lines""",
)
def _(spark, sf):
    return rounded(metrics.classification_report(scored_rows(spark, sf)), "precision", "recall", "f1")


@query(
    "macro_f1",
    f"{sql.WITH_SCORED}, {_LABELS} SELECT round(sum(hits) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM rates",
)
def _(spark, sf):
    return rounded(metrics.macro_f1(scored_rows(spark, sf)), "accuracy", "macro_f1")


@query(
    "unknown_distribution",
    f"{sql.WITH_SCORED} SELECT predicted_label, count(*) AS n FROM scored WHERE NOT ({_KNOWN}) GROUP BY 1",
)
def _(spark, sf):
    return metrics.unknown_distribution(scored_rows(spark, sf))


@query(
    "direction_counts",
    f"{sql.WITH_SCORED} SELECT mismatch_direction, count(*) AS n FROM scored GROUP BY 1 ORDER BY 1",
)
def _(spark, sf):
    return metrics.direction_counts(scored_rows(spark, sf))


@query(
    "anomaly_rate",
    f"""{sql.WITH_SCORED} SELECT count(*) AS total, count_if(is_anomaly) AS flagged,
        round(count_if(is_anomaly) * 1e2 / count(*), 6) AS rate_pct FROM scored""",
)
def _(spark, sf):
    return rounded(metrics.anomaly_rate(scored_rows(spark, sf)), "rate_pct")


@query("critical_miss_count", f"{sql.WITH_SCORED} SELECT CAST(sum({sql.MISS}) AS BIGINT) AS critical_misses FROM scored")
def _(spark, sf):
    return metrics.critical_miss_count(scored_rows(spark, sf))


@query(
    "calibrate_threshold",
    f"{sql.WITH_SCORED} SELECT round(quantile_cont(anomaly_score, 0.95), 6) AS threshold FROM scored",
)
def _(spark, sf):
    return rounded(metrics.exact_percentile(scored_rows(spark, sf), "anomaly_score"), "threshold")


@query(
    "calibrated_flags",
    f"""{sql.WITH_SCORED} SELECT event_id, round(t, 6) AS anomaly_threshold, (severity_distance > 0 AND anomaly_score >= t) AS is_anomaly
        FROM scored, (SELECT quantile_cont(anomaly_score, 0.95) AS t FROM scored)""",
)
def _(spark, sf):
    flagged = metrics.recalibrate(scored_rows(spark, sf))
    return rounded(flagged.select("event_id", "anomaly_threshold", "is_anomaly"), "anomaly_threshold")


_STEPS = f"""steps AS (SELECT anomaly_score AS s, sum({sql.MISS}) AS pos, count(*) AS n FROM scored GROUP BY 1),
 sums AS (SELECT *, sum(pos) OVER () AS p, sum(n) OVER () AS t,
   coalesce(sum(n - pos) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_before,
   sum(pos) OVER (ORDER BY s DESC) AS hits, sum(n) OVER (ORDER BY s DESC) AS reach FROM steps)"""


@query(
    "auroc",
    f"""{sql.WITH_SCORED}, {_STEPS} SELECT CAST(max(p) AS BIGINT) AS positives, CAST(max(t) AS BIGINT) AS total,
        round(sum(pos * (neg_before + (n - pos) / 2e0)) / (max(p) * 1e0 * (max(t) - max(p))), 6) AS auroc FROM sums""",
)
def _(spark, sf):
    out = metrics.ranking_quality(scored_rows(spark, sf), metrics.critical_miss_flag())
    return rounded(out.select("positives", "total", "auroc"), "auroc")


@query(
    "auprc",
    f"""{sql.WITH_SCORED}, {_STEPS} SELECT round(sum(pos * 1e0 / p * (hits * 1e0 / reach)), 6) AS auprc FROM sums""",
)
def _(spark, sf):
    out = metrics.ranking_quality(scored_rows(spark, sf), metrics.critical_miss_flag())
    return rounded(out.select("auprc"), "auprc")


@query(
    "precision_at_k",
    f"""{sql.WITH_SCORED}, ranked AS (SELECT {sql.MISS} AS hit, row_number() OVER (ORDER BY anomaly_score DESC, event_id) AS place,
          sum({sql.MISS}) OVER () AS k FROM scored)
        SELECT CAST(max(k) AS BIGINT) AS k, count(*) AS taken, CAST(sum(hit) AS BIGINT) AS hits,
          round(sum(hit) * 1e0 / count(*), 6) AS precision_at_k FROM ranked WHERE place <= k""",
)
def _(spark, sf):
    out = metrics.precision_at_k(scored_rows(spark, sf), metrics.critical_miss_flag(), "event_id")
    return rounded(out, "precision_at_k")


@query(
    "bench_compare",
    f"""{sql.WITH_SCOREV}, rows AS (SELECT upper(observed) AS t, predicted AS a,
          CASE WHEN event_id % 3 = 0 THEN upper(observed) ELSE predicted END AS b FROM scorev WHERE upper(observed) <> 'UNKNOWN')
        SELECT 'first' AS model, count(*) AS rows, round(count_if(t = a) * 1e2 / count(*), 6) AS accuracy_pct FROM rows
        UNION ALL SELECT 'second', count(*), round(count_if(t = b) * 1e2 / count(*), 6) FROM rows""",
)
def _(spark, sf):
    rows = fixtures.scorev(spark, sf).withColumn("true_label", F.upper("observed")).filter("true_label <> 'UNKNOWN'")
    second = F.when(F.col("event_id") % 3 == 0, F.col("true_label")).otherwise(F.col("predicted"))
    scored = rows.withColumn("second", second)
    return rounded(metrics.model_accuracy(scored, {"first": "predicted", "second": "second"}), "accuracy_pct")


@query(
    "weighted_loss",
    """SELECT round(sum(w * l) / greatest(sum(w), 1e-8), 6) AS loss FROM (
        SELECT (target + 1) / 2e0 AS w, (1 - pow(greatest(exp(z[target + 1]) / list_sum(list_transform(z, lambda x: exp(x))), 1e-8), 0.7e0)) / 0.7e0 AS l
        FROM (SELECT CAST(label % 6 AS INTEGER) AS target, list_transform(embedding[1:6], lambda x: CAST(x AS DOUBLE)) AS z FROM embeddings))""",
)
def _(spark, sf):
    target = (F.col("label") % 6).cast("int")
    p = label_probability(softmax(F.slice("embedding", 1, 6)), target)
    rows = fixtures.emb(spark, sf).select(((target + 1) / F.lit(2.0)).alias("w"), gce_loss(p).alias("l"))
    return rounded(metrics.weighted_loss(rows, "l", "w"), "loss")


@query(
    "class_weights",
    f"""{sql.WITH_PARSED}, n AS (SELECT {sql.class_id('line_level')} AS label, count(*) AS n FROM parsed
          WHERE {sql.class_id('line_level')} IS NOT NULL GROUP BY 1)
        SELECT CAST(i AS INTEGER) AS label, coalesce(n, 0) AS n,
          round(coalesce((SELECT sum(n) FROM n) / (6e0 * n), 0), 6) AS weight FROM range(6) r(i) LEFT JOIN n ON label = i""",
)
def _(spark, sf):
    from logrung.functions.levels import level_id

    rows = parsed_logs(spark, sf).select(level_id(F.col("line_level")).alias("label"))
    return rounded(metrics.class_weights(rows.filter("label IS NOT NULL")), "weight")


@query(
    "auto_labeled",
    f"""{sql.WITH_SCORED_LOGS} SELECT raw_line AS text, message AS masked_text, raw_json, predicted_label AS label,
        round(confidence, 4) AS confidence FROM scored_logs WHERE true_label = 'UNKNOWN'""",
)
def _(spark, sf):
    return auto_labeled(scored_logs(spark, sf))


@query(
    "incorrect_predictions",
    f"""{sql.WITH_SCORED_LOGS} SELECT true_label, predicted_label, round(confidence, 4) AS confidence, mismatch_direction,
        severity_distance AS mismatch_distance, round(anomaly_score, 4) AS anomaly_score, round(anomaly_threshold, 4) AS anomaly_threshold,
        is_anomaly, raw_line AS raw_text, message AS masked_text_seen_by_model, raw_json
        FROM scored_logs WHERE true_label <> predicted_label AND {_KNOWN}""",
)
def _(spark, sf):
    return incorrect_predictions(scored_logs(spark, sf))

"""Queries that run whole jobs: corpus, training, evaluation, scoring, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from logrung import fixtures
from logrung.catalog import sql
from logrung.catalog.base import (
    landed,
    parsed_logs,
    query,
    scored_logs,
    staged_logs,
)
from logrung.catalog.samples import _BUDGETS, _COUNTS, _LINES, _QUOTAS
from logrung.functions.masking import with_masked
from logrung.operators import classify
from logrung.operators.sampling import stratified_split
from logrung.plans.benchmark import benchmark_models
from logrung.plans.clustering import cluster_logs
from logrung.plans.corpus import build_corpus
from logrung.plans.evaluate import evaluate_models, report
from logrung.plans.score import score_requests
from logrung.plans.train import train_models, training_rows
from logrung.session import scratch_path
from logrung.sources.files import scan_parsed
from logrung.sources.sinks import load_model, save_model
from logrung.streaming.score import (
    read_request_stream,
    score_pair_stream,
    write_scores,
)


def _training(spark, sf):
    return landed(training_rows(parsed_logs(spark, sf), ["event_id"]), "training")


def _split(spark, sf):
    split = landed(stratified_split(_training(spark, sf), ["event_id"]), "split")
    return (split.filter(F.col("split") == part) for part in ("train", "validation", "test"))


@query(
    "corpus_job",
    f"""{_LINES}, one_line AS (SELECT 0 AS event_id, dataset, raw_line AS line, '' AS detected_level FROM text_lines WHERE {sql.trimmed('raw_line')} <> ''),
        {sql.PARSED.replace('FROM logv', 'FROM one_line')}, {_COUNTS}, {_BUDGETS}, {_QUOTAS}
        SELECT dataset, level, quota AS sampled FROM quotas WHERE quota > 0""",
)
def _(spark, sf):
    root = staged_logs(spark, sf)
    built = build_corpus(spark, root, scratch_path(spark, "corpus") + "/sample", total=4003, lines_per_file=1500)
    return built.chunked.groupBy("dataset", "level").agg(F.count("*").alias("sampled"))


@query("train_severity")
def _(spark, sf):
    train, _, test = _split(spark, sf)
    model = classify.train_severity(train)
    return classify.score_batch(model, test, "text").select("event_id", "label", "predicted_label", "confidence")


@query("train_severity_gce")
def _(spark, sf):
    train, _, test = _split(spark, sf)
    model = classify.train_severity(train, loss=classify.GCE)
    return classify.score_batch(model, test, "text").select("event_id", "label", "predicted_label", "confidence")


@query("train_both")
def _(spark, sf):
    results, _, _ = train_models(_training(spark, sf), ["event_id"])
    first, second = (r.test.metrics for r in results)
    return first.unionByName(second).drop("run_id")


@query("select_best")
def _(spark, sf):
    train, validation, test = _split(spark, sf)
    model, _, _ = classify.select_best(train, validation, [{"reg": 1e-3}, {"reg": 1e-1}])
    return classify.evaluate_labels(model, test)


def _hash_model():
    """A stand-in for a user's own model: logits from text length."""
    import numpy as np

    def predict(texts):
        size = np.array([[len(t)] for t in texts], dtype=float)
        return -np.abs(size / 20.0 - np.arange(6.0))

    return predict


@query(
    "score_external",
    f"""{sql.WITH_MASKED}, z AS (SELECT event_id, list_transform(range(6), lambda i: -abs(length(masked) / 2e1 - i)) AS z FROM masked)
        SELECT event_id, list_extract(['TRACE','DEBUG','INFO','WARN','ERROR','FATAL'], list_position(z, list_max(z))) AS predicted_label,
          round(100 / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))), 6) AS confidence FROM z""",
)
def _(spark, sf):
    rows = with_masked(parsed_logs(spark, sf), "message", "masked").select("event_id", F.col("masked").alias("message"))
    scored = classify.external_scorer(_hash_model)(rows)
    return scored.select("event_id", "predicted_label", F.round("confidence", 6).alias("confidence"))


@query("score_batch")
def _(spark, sf):
    rows = _training(spark, sf)
    path = scratch_path(spark, "model")
    save_model(classify.train_severity(rows), path)
    return classify.score_batch(load_model(path), rows, "text").select("event_id", "predicted_label", "confidence")


@query("run_metrics")
def _(spark, sf):
    scored = landed(scored_logs(spark, sf), "scored")
    return report(scored, "run", "given", "event_id")


@query("evaluate_job")
def _(spark, sf):
    rows = _training(spark, sf)
    scorers = {
        "weighted": classify.model_scorer(classify.train_severity(rows)),
        "external": classify.external_scorer(_hash_model),
    }
    lines = fixtures.logv(spark, sf).withColumnRenamed("line", "raw_line").withColumn("raw_json", F.lit(None).cast("string"))
    out = scratch_path(spark, "evaluation")
    done = evaluate_models(lines, scorers, ["event_id"], "event_id", "detected_level", out=out)
    return done["weighted"].metrics.unionByName(done["external"].metrics).drop("run_id")


@query("benchmark_job")
def _(spark, sf):
    model = classify.train_severity(_training(spark, sf))
    scorers = {"trained": classify.model_scorer(model), "external": classify.external_scorer(_hash_model)}
    return benchmark_models(parsed_logs(spark, sf), scorers, ["event_id"])


def _requests(spark, sf):
    """Log lines as scoring requests."""
    names = ["app", "container", "detected_level", "filename", "job", "namespace", "node_name", "pod", "service_name", "stream"]
    known = {"app": F.col("dataset"), "detected_level": F.nullif("detected_level", F.lit(""))}
    fields = F.struct(*[known.get(n, F.lit(None).cast("string")).alias(n) for n in names])
    return fixtures.logv(spark, sf).select(
        F.col("event_id").cast("string").alias("timestamp"), "line", fields.alias("fields")
    )


_ANSWER = ["timestamp", "observed_label", "raw_line", "predicted_label", "confidence", "mismatch_direction", "mismatch_distance", "anomaly_score", "is_anomaly"]
_EXTERNAL = f"""guessed AS (SELECT *, list_extract(['TRACE','DEBUG','INFO','WARN','ERROR','FATAL'], list_position(z, list_max(z))) AS predicted_label,
   100 / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))) AS confidence
   FROM (SELECT *, list_transform(range(6), lambda i: -abs(length(masked) / 2e1 - i)) AS z FROM masked))"""
_ANSWER_SQL = f"""{sql.WITH_MASKED}, {_EXTERNAL} SELECT CAST(event_id AS VARCHAR) AS timestamp, observed_severity AS observed_label, raw_line,
   predicted_severity AS predicted_label, round(confidence, 4) AS confidence, mismatch_direction, severity_distance AS mismatch_distance,
   round(anomaly_score, 4) AS anomaly_score, is_anomaly FROM ({sql.mismatch('guessed', 'line_level', 'predicted_label')})"""


@query("score_requests", _ANSWER_SQL)
def _(spark, sf):
    return score_requests(_requests(spark, sf), classify.external_scorer(_hash_model), "timestamp").select(_ANSWER)


@query("request_stream", _ANSWER_SQL)
def _(spark, sf):
    inbox, out, mark = (scratch_path(spark, n) for n in ("inbox", "scores", "stream-checkpoint"))
    _requests(spark, sf).write.json(inbox)
    requests = read_request_stream(spark, inbox)
    scored = score_requests(requests, classify.external_scorer(_hash_model), "timestamp")
    write_scores(scored.drop("metadata"), out, mark, available_now=True).awaitTermination()
    return spark.read.parquet(out).select(_ANSWER)


@query(
    "pair_stream",
    f"{sql.WITH_SCOREV} SELECT event_id, observed_severity, predicted_severity, severity_distance, mismatch_direction, "
    f"confidence, anomaly_score, is_anomaly FROM ({sql.mismatch('scorev', 'observed', 'predicted')})",
)
def _(spark, sf):
    out, mark = scratch_path(spark, "pair-scores"), scratch_path(spark, "stream-checkpoint")
    schema = fixtures.table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    scored = score_pair_stream(fixtures.scorev_of(events))
    write_scores(scored, out, mark, available_now=True).awaitTermination()
    return spark.read.parquet(out).select(
        "event_id", "observed_severity", "predicted_severity", "severity_distance", "mismatch_direction",
        "confidence", "anomaly_score", "is_anomaly",
    )


@query("cluster_job")
def _(spark, sf):
    parsed = parsed_logs(spark, sf).withColumnRenamed("event_id", "row_id")
    result = cluster_logs(parsed, out=scratch_path(spark, "clusters"), n_components=4)
    return result.purity.drop("level_counts")


@query(
    "scan_parse_job",
    f"""{_LINES}, one_line AS (SELECT 0 AS event_id, dataset, raw_line AS line, '' AS detected_level FROM text_lines WHERE {sql.trimmed('raw_line')} <> ''),
        {sql.PARSED.replace('FROM logv', 'FROM one_line')} SELECT dataset, upper(line_level) AS level, count(*) AS n FROM parsed GROUP BY 1, 2""",
)
def _(spark, sf):
    parsed = scan_parsed(spark, staged_logs(spark, sf))
    return parsed.groupBy("dataset", F.upper("line_level").alias("level")).agg(F.count("*").alias("n"))

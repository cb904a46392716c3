"""Classifier, embedding, mixture and the jobs around them."""

import hashlib
import re
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.sql import functions as F

from logrung.functions.vectors import argmax, gce_loss, label_probability, mean_pool, softmax, wce_loss
from logrung.operators import classify, cluster, embed, mixture
from logrung.operators.metrics import weighted_loss
from logrung.plans.benchmark import benchmark_models
from logrung.plans.evaluate import evaluate_rows, error_sample, sample_inputs
from logrung.plans.score import refused_requests, score_line, score_pairs, score_requests
from logrung.sources.records import REQUEST_SCHEMA
from logrung.sources.sinks import load_model, save_model
from logrung.streaming.score import read_line_stream, read_request_stream, score_request_stream, write_scores

# The workers cannot import this file, so its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = {0: "enter leave", 1: "cache lookup", 2: "started ready", 3: "slow retry", 4: "failed refused", 5: "panic abort"}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        label = 4 if i % 3 == 0 else int(rng.integers(0, 6))
        shown = label if rng.random() > 0.1 else int(rng.integers(0, 6))
        rows.append((i, f"node <NUM> {WORDS[shown]} again", label))
    return spark.createDataFrame(rows, "id long, text string, label int").repartition(4).cache()


@pytest.fixture(scope="module")
def model(labelled):
    return classify.train_severity(labelled, buckets=256, max_iter=15)


def test_training_learns(labelled, model):
    assert classify.evaluate_labels(model, labelled).first().macro_f1 > 0.7


def test_noise_tolerant_loss_does_not_rise(labelled, model):
    robust = classify.train_severity(labelled, loss=classify.GCE, rounds=2, buckets=256, max_iter=15)

    def loss(m):
        rows = classify.target_losses(m, labelled).select(gce_loss(F.col("p")).alias("l"), classify.weight_of(labelled).alias("w"))
        return weighted_loss(rows, "l", "w").first().loss

    assert loss(robust) <= loss(model) + 1e-9
    with pytest.raises(ValueError):
        classify.train_severity(labelled, loss="other")


def test_embedding_by_the_plain_definition(spark, monkeypatch):
    texts = ["node <NUM> failed", None, "", " \t ", "a a\u00a0b \u00e9 a", "x\ny  z ", "w" * 9, *[" ".join(f"t{j}" for j in range(i)) for i in range(40)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "id int, message string")
    model = embed.fit_embedder(df, size=130)
    weights = model.weights.first()[0]

    def plain(text):
        total, sums = 0.0, [0.0] * 130
        for w in re.split("[ \t\n\x0b\f\r]+", text or ""):
            if w:
                f = weights[int(hashlib.md5(w.encode()).hexdigest()[:3], 16)]
                h = "".join(hashlib.md5(f"94:{k}:{w}".encode()).hexdigest() for k in range(2))
                bits = bin(int(h, 16))[2:].zfill(256)
                total, sums = total + f, [s + f * (1 - 2 * int(b)) for s, b in zip(sums, bits)]
        return [s / max(total, 1e-9) for s in sums]

    got = [r.embedding for r in embed.embed_messages(model, df).orderBy("id").collect()]
    assert got == [plain(t) for t in texts * 2]
    # Neither a small table of signs nor few bytes at a time change a vector, and the table stays small.
    monkeypatch.setattr(embed, "_KEPT_TOKENS", 8)
    monkeypatch.setattr(embed, "_BYTES_AT_ONCE", 30)
    signs = embed._TokenSigns(np.array(weights), 130, 94, 2)
    assert [v.tolist() for v in signs.vectors([(t or "").encode() for t in texts])] == got[: len(texts)]
    assert len(signs._codes) <= 8 + len(texts)


def test_external_model_gets_texts_only(spark):
    rows = spark.createDataFrame([(1, "abc", None, b"x"), (2, "abcdef", 7, None)], "id int, message string, n long, raw binary")
    got = classify.external_scorer(by_length)(rows)
    assert "MapInPandas" not in got._jdf.queryExecution().executedPlan().toString()
    assert [(r.id, r.message, r.n, r.raw) for r in got.orderBy("id").collect()] == [(1, "abc", None, bytearray(b"x")), (2, "abcdef", 7, None)]
    assert got.columns == ["id", "message", "n", "raw", "predicted_label", "confidence"]


def test_equal_rows_are_fitted_together(spark, labelled, model):
    counted = labelled.groupBy("text", "label").agg(F.count("*").alias("_n"))
    # A text of most rows is cut into parts; no row is lost.
    heavy = counted.withColumn("_n", F.when(F.col("_n") == counted.agg(F.max("_n")).scalar(), 1_000_000).otherwise(F.col("_n")))
    rows, distinct = heavy.agg(F.sum("_n")).first()[0], heavy.count()
    held = classify._fit_rows(heavy, 1000).agg(F.sum("_rows"), F.count("*"), F.max("_rows")).first()
    assert held[0] == rows and distinct < held[1] <= 1000 + distinct and held[2] == -(-rows // 1000)
    # The model is that of the single rows, and of a plain document frequency.
    many = labelled.crossJoin(spark.range(50).select(F.col("id").alias("copy")))
    settings = {"buckets": 256, "max_iter": 60}
    pick = lambda m: [r.confidence for r in classify.score_batch(m, labelled, "text").orderBy("id").collect()]
    together = pick(classify.train_severity(many, parts=2000, **settings))
    assert np.allclose(together, pick(classify.train_severity(many, **settings)), rtol=1e-3)
    words = RegexTokenizer(inputCol="text", outputCol="w", pattern=r"\s+", toLowercase=False)
    tf = HashingTF(inputCol="w", outputCol="c", numFeatures=256)
    plain = Pipeline(stages=[words, tf, IDF(inputCol="c", outputCol="f")]).fit(labelled).stages[2].idf
    assert np.allclose(model.stages[2].getScalingVec().toArray(), plain.toArray(), rtol=1e-12)


def test_model_roundtrip(labelled, model, tmp_path):
    save_model(model, str(tmp_path / "m"))
    loaded = load_model(str(tmp_path / "m"))
    pick = lambda m: classify.score_batch(m, labelled, "text").orderBy("id").select("predicted_label", "confidence").collect()
    assert pick(loaded) == pick(model)
    assert all(100 / 6 <= r.confidence <= 100 for r in pick(model))


def test_best_model_by_macro_f1(labelled):
    _, settings, score = classify.select_best(labelled, labelled, [{"buckets": 1}, {"buckets": 256}], max_iter=10)
    assert settings == {"buckets": 256} and score > 0.7
    with pytest.raises(ValueError):
        classify.select_best(labelled, labelled, [])


def test_score_one_line(spark, model):
    row = score_line(spark, "2024-01-01 10:00:00 ERROR [x] node 7 failed refused again", classify.model_scorer(model)).first()
    assert (row.message, row.line_level, row.predicted_label) == ("node <NUM> failed refused again", "ERROR", "ERROR")


def by_length():
    def predict(texts):
        return np.array([[1.0, 2.0, 3.0, 2.0, 1.0, float(len(t) > 5) * 9] for t in texts])

    return predict


REQUESTS = [
    ("t1", "ERROR: short", ("a",) + (None,) * 9),
    ("t2", "", None),
    (None, "INFO: x", None),
    ("t3", "ERR: a longer message", None),
]


def test_requests(spark):
    rows = spark.createDataFrame(REQUESTS, REQUEST_SCHEMA)
    got = {r.timestamp: r for r in score_requests(rows, classify.external_scorer(by_length), "timestamp").collect()}
    assert set(got) == {"t1", "t3"} and refused_requests(rows).count() == 2
    assert (got["t1"].observed_label, got["t1"].predicted_label, got["t1"].mismatch_direction) == ("ERROR", "INFO", "under_prediction")
    assert got["t1"].metadata.app == "a" and got["t1"].metadata.detected_level == "unknown"
    # ERR is no name of the severity scale, so it is scored as INFO.
    assert (got["t3"].observed_label, got["t3"].predicted_label, got["t3"].mismatch_distance) == ("INFO", "FATAL", 3)
    assert score_requests(rows.limit(0), classify.external_scorer(by_length)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame(REQUESTS * 3, REQUEST_SCHEMA)
    rows.repartition(3).write.json(str(tmp_path / "in"))
    scorer = classify.external_scorer(by_length)
    stream = score_request_stream(read_request_stream(spark, str(tmp_path / "in"), 1), scorer).drop("metadata")
    write_scores(stream, str(tmp_path / "out"), str(tmp_path / "mark"), available_now=True).awaitTermination()
    batch = score_requests(rows, scorer).drop("metadata")
    got = spark.read.parquet(str(tmp_path / "out")).select(batch.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    assert got.count() == 6


def test_text_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("ERROR: short\n\nINFO: fine\n")
    scored = score_request_stream(read_line_stream(spark, str(tmp_path / "in")), classify.external_scorer(by_length))
    write_scores(scored.drop("metadata"), str(tmp_path / "out"), str(tmp_path / "mark"), available_now=True).awaitTermination()
    assert {r.observed_label for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"ERROR", "INFO"}


def test_pairs(spark):
    rows = spark.createDataFrame([("ERROR", "INFO", 100.0), ("ERROR", "INFO", 101.0), ("ERROR", "INFO", None)], "observed string, predicted string, confidence double")
    assert [r.anomaly_score for r in score_pairs(rows).collect()] == [60.0]


def test_evaluation_report(spark, labelled, model, tmp_path):
    rows = labelled.select(
        "id", F.col("text").alias("message"), F.col("text").alias("raw_line"), F.lit(None).cast("string").alias("raw_json"),
        F.when(F.col("id") % 10 == 0, "UNKNOWN").when(F.col("label") == 4, "ERROR").otherwise("INFO").alias("true_label"),
    )
    done = evaluate_rows(rows, classify.model_scorer(model), "m", "id", str(tmp_path))
    values = {(r.metric, r.label): r.value for r in done.metrics.collect()}
    assert values[("total", "")] == 240 and values[("known", "")] == 216
    assert 0 <= values[("auroc", "")] <= 1 and values[("threshold", "")] > 0
    assert spark.read.json(str(tmp_path / "m" / f"{done.run_id}_auto_labeled_logs")).count() == 24
    assert spark.read.parquet(str(tmp_path / "metrics")).filter("model = 'm'").count() == len(values)
    assert error_sample(done.scored, ["id"]).count() == 10 and sample_inputs(rows, ["id"]).count() == 30


def test_benchmark_uses_one_sample(spark, model):
    rows = spark.range(60).select("id", F.lit("node failed refused").alias("message"), F.when(F.col("id") < 40, "error").otherwise("UNKNOWN").alias("line_level"))
    got = {r.model: r for r in benchmark_models(rows, {"m": classify.model_scorer(model), "x": classify.external_scorer(by_length)}, ["id"], 25).collect()}
    assert got["m"].rows == got["x"].rows == 25
    assert (got["m"].accuracy_pct, got["x"].accuracy_pct) == (100.0, 0.0)


def test_vector_functions(spark):
    row = spark.sql("SELECT array(1D, 3D, 2D) AS z, array(array(1D, 2D), array(3D, 4D), array(9D, 9D)) AS v, array(1D, 1D, 0D) AS m").select(
        softmax(F.col("z")).alias("p"), argmax(F.col("z")).alias("a"), mean_pool(F.col("v"), F.col("m"), 2).alias("pool"),
        gce_loss(F.lit(0.5)).alias("g"), wce_loss(F.lit(0.5), F.lit(2.0)).alias("w"), label_probability(F.col("z"), F.lit(1)).alias("q"),
    ).first()
    e = np.exp([1, 3, 2])
    assert row.p == pytest.approx(list(e / e.sum())) and row.a == 1 and row.pool == [2.0, 3.0] and row.q == 3.0
    assert row.g == pytest.approx((1 - 0.5**0.7) / 0.7) and row.w == pytest.approx(2 * np.log(2))
    with pytest.raises(ValueError):
        gce_loss(F.lit(0.5), 0.0)


def test_labels_outside_the_six(spark):
    df = spark.createDataFrame([([0.0] * 7 + [3.0],), ([9.0] + [0.0] * 7,)], "logits array<double>")
    assert [r.predicted_label for r in classify.label_from_logits(df).collect()] == ["UNKNOWN", "TRACE"]
    assert classify.label_from_logits(df, numbered=True).first().predicted_label == "CLASS_ID_7"


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 5)) * [5, 3, 1, 0.5, 0.1] + 100
    df = spark.createDataFrame(pd.DataFrame({"i": range(80), "embedding": x.tolist()}))
    got = np.array([r.reduced for r in embed.reduce_dims(df, 3).orderBy("i").collect()])
    u, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    want = (x - x.mean(axis=0)) @ (vt[:3] * np.sign([v[np.abs(v).argmax()] for v in vt[:3]])[:, None]).T
    assert np.allclose(got, want, atol=1e-8)
    assert len(embed.reduce_dims(df, 100).first().reduced) == 5


def test_mixture_finds_the_groups_and_drops_spare_components(spark):
    rng = np.random.default_rng(2)
    centres = np.array([[0, 0], [12, 0], [0, 12]])
    x = np.vstack([rng.normal(size=(100, 2)) + c for c in centres])
    df = spark.createDataFrame(pd.DataFrame({"i": range(300), "reduced": x.tolist()})).repartition(3)
    fitted = mixture.fit_mixture(df, n_components=5, restarts=3)
    assert (fitted.weights() > 0.05).sum() == 3
    got = mixture.assign_clusters(df, fitted).toPandas().sort_values("i")["cluster"].to_numpy()
    groups = [set(got[k * 100 : (k + 1) * 100]) for k in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3


def test_equal_vectors_are_fitted_together(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(20, 2)) + c for c in ([0, 0], [15, 0], [0, 15])])
    df = spark.createDataFrame(pd.DataFrame({"i": range(60), "reduced": x.tolist()}))
    many = df.crossJoin(spark.range(40)).coalesce(1)
    held = mixture._fit_rows(many.select(F.col("reduced").alias("x")), 600)
    assert held.agg(F.sum("w"), F.count("*"), F.max("w")).first()[:] == (2400.0, 600, 4.0)
    # One file of very many vectors is no longer one task.
    assert held.rdd.getNumPartitions() > 1
    together, single = (mixture.fit_mixture(many, n_components=3, restarts=2, parts=p) for p in (600, 1 << 20))
    by_place = lambda m: np.array(sorted(m.means.tolist()))
    assert np.allclose(by_place(together), by_place(single), atol=1e-3) and abs(together.bound - single.bound) < 0.1
    mean, variance = mixture._moments(held)
    rows = np.repeat(x, 40, axis=0)
    assert np.allclose(mean, rows.mean(axis=0)) and np.allclose(variance, rows.var(axis=0, ddof=1))


def test_cluster_reports(spark):
    rows = [(0, 0, "INFO", "a"), (1, 0, "WARN", "b"), (2, 0, "WARN", "c"), (3, 0, "INFO", "d"), (4, 1, "ERROR", "e")]
    df = spark.createDataFrame(rows, "row_id long, cluster int, level string, message string")
    got = {r.cluster: r for r in cluster.cluster_purity(df).collect()}
    assert (got[0].majority_level, got[0].purity_pct, got[0].level_counts) == ("INFO", 50.0, {"INFO": 2, "WARN": 2})
    assert (got[1].majority_level, got[1].purity_pct) == ("ERROR", 100.0)
    lines = sorted(r.outlier for r in cluster.cluster_outliers(df).collect())
    assert lines == ["[Cluster 0] Tagged as [WARN]: b", "[Cluster 0] Tagged as [WARN]: c"]


def test_gaussian_axes(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 3)) * [3, 2, 1]
    frame = pd.DataFrame({"cluster": [0] * 47 + [1] * 3, "v": x.tolist()})
    row, = cluster.gaussian_axes(cluster.gaussian_moments(spark.createDataFrame(frame), "v", 3), 3).collect()
    values = np.linalg.eigvalsh(np.cov(x[:47], rowvar=False))
    assert row.cluster == 0 and np.allclose(row.eigenvalues, values) and np.allclose(row.radii, 2 * np.sqrt(values))

"""Row ids of file scans, dataset keys of odd roots, jobs that run from a folder."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from logrung.operators.classify import external_scorer
from logrung.operators.sampling import uniform_sample
from logrung.plans.clustering import cluster_logs
from logrung.plans.evaluate import evaluate_models
from logrung.sources import files


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    levels = ["INFO", "ERROR", "WARN", "DEBUG"]
    for name, n in (("a/x.log", 700), ("a/y.log", 3), ("b/z.log", 400), ("top.log", 50)):
        os.makedirs(root / os.path.dirname(name), exist_ok=True)
        lines = [f"2024-01-02 03:04:{i % 60:02d} {levels[i % 4]} [w] app: step {i} of {name}" for i in range(n)]
        lines[2] = ""
        (root / name).write_text("\n".join(lines) + "\n")
    return str(root)


def _rows(spark, folder, split, cores):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = [spark.conf.get(k, None) for k in keys]
    for key, value in zip(keys, (split, "1", cores), strict=True):
        spark.conf.set(key, value)
    try:
        rows = files.scan_text(spark, folder)
        drawn = uniform_sample(rows, 50, ["file_path", "block", "pos"], 3)
        return rows.rdd.getNumPartitions(), sorted(map(tuple, rows.collect())), sorted(map(tuple, drawn.collect()))
    finally:
        for key, value in zip(keys, before, strict=True):
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_row_ids_and_draws_do_not_depend_on_splits(spark, folder):
    few, rows, drawn = _rows(spark, folder, "134217728", "1")
    many, again, drawn_again = _rows(spark, folder, "997", "8")
    assert many > few
    assert rows == again and drawn == drawn_again and len(drawn) == 50
    numbers = [r[2] for r in rows if r[0].endswith("x.log")]
    assert numbers == [i for i in range(700) if i != 2]


def test_dataset_keys_of_relative_roots(spark, folder, monkeypatch):
    monkeypatch.chdir(os.path.dirname(folder))
    name = os.path.basename(folder)
    for root in (folder, folder + "/", f"{folder}/a/..", f"file://{folder}"):
        keys = {r.dataset for r in files.scan_directory(spark, root).select("dataset").distinct().collect()}
        assert keys == {"a", "b", "top"}, root
    assert shutil.os.path.isdir(name)


def test_jobs_from_a_folder(spark, folder):
    def length_model():
        import numpy as np

        return lambda texts: -np.abs(np.array([[len(t)] for t in texts], dtype=float) / 20.0 - np.arange(6.0))

    parsed = files.scan_parsed(spark, folder)
    result = cluster_logs(parsed, n_components=2)
    assert sum(r.size for r in result.purity.collect()) == parsed.where("line_level <> 'UNKNOWN' and message <> ''").count()
    assert {"file_path", "pos"} == set(result.outliers.select("row_id.*").columns)
    rows = files.scan_directory(spark, folder).withColumn("_level", F.col("metadata.detected_level"))
    done = evaluate_models(
        rows, {"m": external_scorer(length_model)}, ["file_path", "block", "pos"], detected="_level", threshold=10.0, under_weight=2.0
    )["m"]
    metrics = {r.metric: r.value for r in done.metrics.collect()}
    assert "precision_at_k" in metrics and metrics["total"] == rows.count()

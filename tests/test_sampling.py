"""Quotas, samples and splits, with one stratum holding most rows."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logrung.operators import ranks, sampling


def quotas_of(spark, counts, budget):
    rows = [("d", k, v) for k, v in counts.items()]
    table = spark.createDataFrame(rows, "dataset string, level string, n long")
    budgets = spark.createDataFrame([("d", budget)], "dataset string, budget long")
    return {r.level: r.quota for r in sampling.level_quotas(table, budgets).collect()}


def test_quotas(spark):
    assert quotas_of(spark, {"INFO": 70, "ERROR": 30}, 100) == {"INFO": 70, "ERROR": 30}
    assert sum(quotas_of(spark, {"INFO": 7, "ERROR": 3}, 5).values()) == 5
    # Both shares end in .5; the later name gets the row.
    assert quotas_of(spark, {"INFO": 7, "ERROR": 3}, 5) == {"INFO": 4, "ERROR": 1}
    capped = quotas_of(spark, {"RARE": 1, "COMMON": 100}, 50)
    assert capped["RARE"] <= 1 and capped["COMMON"] <= 100
    assert quotas_of(spark, {}, 10) == {}
    assert set(quotas_of(spark, {"INFO": 5}, 0).values()) == {0}


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.sampled_from("ABCDEFG"), st.integers(1, 500), min_size=1), st.integers(1, 900))
def test_quotas_sum_to_the_budget(spark, counts, budget):
    got = quotas_of(spark, counts, budget)
    assert sum(got.values()) == min(budget, sum(counts.values()))
    assert all(0 <= got[k] <= counts[k] for k in counts)


def test_budgets(spark):
    counts = spark.createDataFrame([(d, "INFO", 5) for d in "cab"], "dataset string, level string, n long")
    got = {r.dataset: r.budget for r in sampling.dataset_budgets(counts, 11).collect()}
    assert got == {"a": 4, "b": 4, "c": 3}


def key(seed, i):
    return hashlib.md5(f"{seed}:{i}".encode()).hexdigest()


def test_stratified_sample_equals_brute_force(spark):
    # Two thirds of the rows fall in one stratum.
    level = F.when(F.col("id") % 3 < 2, "INFO").when(F.col("id") % 2 == 0, "warn").otherwise("ERROR")
    rows = spark.range(5000).select("id", F.lit("d").alias("dataset"), level.alias("line_level"), F.lit("x").alias("raw_line"))
    quotas = spark.createDataFrame([("d", "INFO", 700), ("d", "WARN", 9999), ("d", "ERROR", 0)], "dataset string, level string, quota long")
    got = sampling.stratified_sample(rows, quotas, ["id"], 42).collect()
    strata = {"INFO": [i for i in range(5000) if i % 3 < 2], "WARN": [i for i in range(5000) if i % 3 == 2 and i % 2 == 0]}
    want = set(sorted(strata["INFO"], key=lambda i: key(42, i))[:700]) | set(strata["WARN"])
    assert len(got) == len(want) and {r.id for r in got} == want


def test_uniform_sample_and_first_rows(spark):
    rows = spark.range(3000)
    want = set(sorted(range(3000), key=lambda i: key(94, i))[:500])
    assert {r.id for r in sampling.uniform_sample(rows, 500, ["id"]).collect()} == want
    assert sampling.uniform_sample(rows, 9999, ["id"]).count() == 3000
    assert sampling.uniform_sample(rows, 0, ["id"]).count() == 0
    filed = rows.select((F.col("id") % 3).alias("f"), "id")
    first = sampling.first_rows(filed, 1200, ["f"], ["id"]).collect()
    assert {(r.f, r.id) for r in first} == set(sorted((i % 3, i) for i in range(3000))[:1200])


def test_global_rank(spark):
    rows = sampling.with_hash_order(spark.range(2000), 1, "id")
    got = ranks.global_rank(rows, ["_bucket"], ["_key"]).collect()
    order = sorted(range(2000), key=lambda i: key(1, i))
    assert {r.id: r["rank"] for r in got} == {i: n + 1 for n, i in enumerate(order)}


def test_split_is_a_partition(spark):
    label = F.when(F.col("id") < 700, 2).when(F.col("id") < 997, 4).otherwise(5)
    rows = spark.range(1000).select("id", label.alias("label"))
    split = sampling.stratified_split(rows, ["id"])
    got = split.collect()
    # Three rows of class 5 are too few and go.
    assert len(got) == len({r.id for r in got}) == 997 and {r.label for r in got} == {2, 4}
    sizes = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    assert sizes == {"train": 797, "validation": 100, "test": 100}
    again = sampling.stratified_split(rows, ["id"])
    assert {(r.id, r.split) for r in again.collect()} == {(r.id, r.split) for r in got}
    with pytest.raises(ValueError):
        sampling.stratified_split(rows, ["id"], (0.8, 0.1, 0.2))


def test_split_of_tiny_classes(spark):
    rows = spark.range(8).select("id", (F.col("id") % 2).cast("int").alias("label"))
    parts = [r.split for r in sampling.stratified_split(rows, ["id"]).collect()]
    assert sorted(parts) == ["test"] + ["train"] * 6 + ["validation"]


def test_rare_classes(spark):
    rows = spark.createDataFrame([(1,)] * 3 + [(2,)] * 4, "label int")
    counts = sampling.class_counts(rows)
    assert {r.label: r.kept for r in counts.collect()} == {1: False, 2: True}
    assert sampling.drop_rare(rows, counts).count() == 4


def test_large_strata_are_ranked_in_buckets(spark):
    """Every window over rows is partitioned by a bucket, never by stratum alone."""
    rows = sampling.with_hash_order(spark.range(100), 1, "id")
    plan = ranks.global_rank(rows, ["_bucket"], ["_key"])._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_bucket" in w for w in windows)

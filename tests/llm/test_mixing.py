"""Mixing to target weights against a plain version."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from logrung.llm.mixing import mixed_rows, mixed_sizes, source_targets


def _slow_targets(sizes, weights=(1, 2, 3), epochs=3):
    """Clamp and reshare until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        if not free:
            return fixed
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > epochs * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: epochs * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(6))
def test_targets_equal_resharing_in_rounds(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 5, 100, 1000, 50_000]) for i in range(rng.randint(1, 12))} | {None: rng.randint(0, 900)}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(rows).collect()}
    want = _slow_targets(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in want)


def _documents(spark, n=900):
    rng = random.Random(7)
    rows = [(i, "w " * int(rng.lognormvariate(4, 1)), rng.choice(["b"] * 6 + ["a", "é", "Z", None, ""])) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_takes_are_near_targets_and_stay_below_the_cap(spark):
    docs = _documents(spark)
    rows = mixed_sizes(docs.repartition(5)).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    sums, largest = {}, {}
    for r in rows:
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        s = source[r.doc_id]
        sums.setdefault(s, [0, r.target])[0] += r.taken
        largest[s] = max(largest.get(s, 0), r.size)
    for s, (taken, target) in sums.items():
        assert abs(taken - target) <= largest[s] / 2 + 1e-6
    again = mixed_sizes(docs.repartition(2)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_rest_goes_by_the_order_of_draws(spark):
    rows = mixed_sizes(_documents(spark)).collect()
    source = {r.doc_id: r.source for r in _documents(spark).collect()}
    by = {}
    for r in rows:
        by.setdefault(source[r.doc_id], []).append((hashlib.md5(f"20:{r.doc_id}".encode()).hexdigest(), r))
    for own in by.values():
        size, target = own[0][1].source_size, own[0][1].target
        whole = int(target // size)
        upto = 0
        for _, r in sorted(own, key=lambda x: x[0]):
            upto += r.size
            extra = whole < 3 and 2 * upto - r.size <= 2 * (target - whole * size) and target > whole * size
            assert r.taken == r.size * (whole + extra)


def test_rows_come_as_often_as_they_are_taken(spark):
    docs = _documents(spark).select("*", F.lit("c").alias("row"), F.lit("c").alias("copies"), F.lit(1).alias("draw"))
    taken = {r.doc_id: r.taken // r.size for r in mixed_sizes(docs).collect() if r.size}
    mixed = mixed_rows(docs)
    assert mixed.columns == docs.columns
    count = {r.doc_id: r["count"] for r in mixed.where("length(text) > 0").groupBy("doc_id").count().collect()}
    assert count == {d: n for d, n in taken.items() if n}


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "a b", "x"), (None, "a b", "x"), (2, "", "y"), (3, " \t", None), (4, re.sub("^", "w ", "z " * 40_000), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixed_sizes(docs).collect()
    assert len(got) == len(rows) and sum(r.size for r in got) == 2 + 2 + 40_001
    assert mixed_sizes(docs.limit(0)).collect() == [] and mixed_rows(docs.limit(0)).collect() == []
    only_empty = spark.createDataFrame([(1, None, "x"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixed_sizes(only_empty).collect()] == [(0, 0.0, 0)] * 2

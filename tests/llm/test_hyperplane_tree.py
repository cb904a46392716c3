"""Hyperplane tree and hard negatives against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logrung.llm.hyperplane_tree import Block, Searches, Space, bounds, build_index, far_apart, hard_negatives, window_search


def _clustered(rng, n, dims, spread=4):
    centres = rng.integers(-200, 200, (12, dims))
    values = centres[rng.integers(0, 12, n)] + rng.integers(-spread, spread + 1, (n, dims))
    values[: n // 3] = values[0]
    return values


@pytest.mark.parametrize(("fanout", "leaf_rows"), [(2, 1), (4, 7), (16, 50)])
def test_ranges_hold_all_rows_below(fanout, leaf_rows):
    rng = np.random.default_rng(fanout)
    values = _clustered(rng, 700, 5)
    space = Space(5, float((values * values).sum(axis=1).max()) + 1e-9)
    block = Block.build(np.arange(700), np.zeros(700, np.int64), values, space, fanout, leaf_rows)
    lifted = space.lifted(block.values)
    assert sorted(block.ids.tolist()) == list(range(700)) and np.array_equal(values[block.ids], block.values)
    assert np.allclose(np.linalg.norm(lifted, axis=1) ** 2, space.square)

    def rows_below(child):
        if child < 0:
            return list(range(block.leaves[-1 - child], block.leaves[-child]))
        return [r for c in block.children[block.first[child] : block.first[child + 1]] for r in rows_below(c)]

    at = 0
    for node in range(len(block.first) - 1):
        splits = block.splits[block.first[node] : block.first[node + 1]]
        for i, p in enumerate(splits):
            for j, child in enumerate(block.children[block.first[node] : block.first[node + 1]]):
                away = np.linalg.norm(lifted[rows_below(child)] - lifted[p], axis=1)
                low, high = block.low[at + i * len(splits) + j], block.high[at + i * len(splits) + j]
                if len(away):
                    assert abs(away.min() - low) < 1e-3 and abs(away.max() - high) < 1e-3
                    assert not len(away) or i != j or high <= away.max() + 1e-3
        at += len(splits) ** 2
    assert sorted(rows_below(0)) == list(range(700))


def test_subtrees_are_left_out_and_results_stay(tmp_path):
    rng = np.random.default_rng(3)
    values = _clustered(rng, 4000, 6)
    labels, ids = rng.integers(0, 3, 4000), rng.permutation(4000)
    space = Space(6, float((values * values).sum(axis=1).max()) + 1e-9)
    Block.build(ids, labels, values, space, 8, 40).write(str(tmp_path / "b.arrow"))
    block = Block.read(str(tmp_path / "b.arrow"), 6)
    of = np.repeat(np.arange(20), 2)
    asked = values[-20:]
    scores = asked @ values.T
    least = np.where(np.arange(40) % 2, (scores.max(axis=1)[of] * 0.3).astype(np.int64), -(1 << 62))
    most = np.where(np.arange(40) % 2, (scores.max(axis=1)[of] * 0.7).astype(np.int64), 1 << 62)
    for same in (True, False):
        s = Searches(space, asked, of, ids[-20:][of], labels[-20:][of], same, least, most, 4)
        s.descend(block)
        assert s.rows_scored < 0.6 * 20 * 4000
        for i in range(40):
            ok = ((labels == labels[-20:][of[i]]) == same) & (ids != ids[-20:][of[i]])
            ok &= (scores[of[i]] >= least[i]) & (scores[of[i]] <= most[i])
            want = sorted((-int(x), int(n)) for x, n in zip(scores[of[i]][ok], ids[ok], strict=True))[:4]
            got = [(-int(x), int(n)) for x, n in zip(s.best_scores[i], s.best_ids[i], strict=True) if n != np.iinfo(np.int64).max]
            assert got == want


def test_bounds_of_a_point_in_a_subtree():
    least, most = bounds(np.array([[5.0, 1.0]]), np.array([[1.0, 2.0], [4.0, 0.0]]), np.array([[2.0, 9.0], [6.0, 1.0]]))
    assert least.tolist() == [[3.0, 0.0]] and most.tolist() == [[7.0, 2.0]]
    assert far_apart(np.array([[0.0], [0.0], [3.0], [1.0]]), 4, 1e-6).tolist() == [0, 2, 3]


def _slow(rows, scale=256, low=30, high=90, positives=5, negatives=10, step=100):
    good = [
        (i, lab, [int(np.floor(np.float32(x).astype(float) * scale)) for x in v])
        for i, lab, v in rows
        if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for i, lab, v in good:
        if i % step:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in good if j != i]  # noqa: B905
        for s, p, _ in sorted(x for x in scored if x[2] == lab)[:positives]:
            fits = sorted((t, j) for t, j, m in scored if m != lab and low * -s <= 100 * -t <= high * -s)
            out += [(i, p, k, j, -s, -t) for k, (t, j) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def test_tables_with_odd_rows(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(3), [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.999]) for _ in range(6)]) for i in range(400)]
    rows += [(500, 1, None), (None, 1, [1.0] * 6), (600, None, [1.0] * 6), (700, 0, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (800, 0, [float("nan")] * 6)]
    rows += [(900, 1, [float("-inf")] * 6), (1000, 2, []), (1100, 2, [0.5, 0.5]), (1200, 7, [0.1] * 6), (1300, 1, [-0.01] * 6)]
    rows += [(50, 1, [0.3] * 6)] * 150 + [(51, 0, [0.3] * 6)] * 3 + [(1400 + i, i % 2, [0.25, 0.999] * 3) for i in range(200)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("score", F.lit("clash")).withColumn("row", F.lit(0))
    want = _slow(rows)
    for settings in ({}, {"rows_per_block": 40, "blocks_per_stripe": 3, "fanout": 3, "leaf_rows": 6}, {"rows_per_block": 100, "most_cells": 2, "leaf_rows": 1, "fanout": 2}):
        got = hard_negatives(table.repartition(3), F.col("vec_id") % 100 == 0, 256.0, **settings)
        assert sorted(map(tuple, got.collect())) == want
    assert hard_negatives(table.limit(0), F.col("vec_id") % 100 == 0, 256.0).collect() == []
    one = table.where("vec_id = 100")
    assert hard_negatives(one, F.col("vec_id") % 100 == 0, 256.0).collect() == []


def test_other_windows_and_wide_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 4, (rng.uniform(-1, 1, 3) * 2.0**26).tolist()) for i in range(90)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = hard_negatives(table, F.col("vec_id") % 30 == 0, 8.0, 2, 3, 10, 99, rows_per_block=20, leaf_rows=4)
    assert sorted(map(tuple, got.collect())) == _slow(rows, 8, 10, 99, 2, 3, 30)
    big = spark.createDataFrame([(0, 0, [2.0**60]), (1, 0, [1.0])], "vec_id long, label int, embedding array<double>")
    with pytest.raises(OverflowError, match="long"):
        hard_negatives(big, F.col("vec_id") == 0, 1.0)


def test_search_of_all_rows_is_exact(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(
        "vec_id", F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("q"),
        F.monotonically_increasing_id().alias("row"),
    )
    every = F.array(F.struct(F.col("row").alias("search"), F.lit(-(1 << 62)).alias("least"), F.lit(1 << 62).alias("most")))
    many = window_search(vectors.withColumn("windows", every), build_index(vectors, rows_per_block=60, leaf_rows=9), 2, True, per_group=33)
    values = np.array([r.q for r in vectors.orderBy("vec_id").select("q").collect()])
    meta = vectors.orderBy("vec_id").select("vec_id", "label", "row").collect()
    ids, labels = np.array([m.vec_id for m in meta]), np.array([m.label for m in meta])
    scores = values @ values.T
    want = set()
    for i, m in enumerate(meta):
        ok = np.flatnonzero((labels == labels[i]) & (ids != ids[i]))
        best = sorted((-int(scores[i, j]), int(ids[j])) for j in ok)[:2]
        want |= {(m.row, k, n, -s) for k, (s, n) in enumerate(best, 1)}
    assert {tuple(r) for r in many.collect()} == want

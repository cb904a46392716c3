"""Bit-sliced search and url filter against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logrung.llm.bit_sliced import SlicedBlock, build_index, search_table, top_k
from logrung.llm.url_filter import DigestShard, build_digests, judge


@pytest.mark.parametrize("spread", [1, 3, 100, 1 << 20])
def test_block_scores_and_best_rows(spread):
    rng = np.random.Generator(np.random.PCG64(spread))
    for n, dims in ((1, 1), (5, 3), (64, 8), (300, 17)):
        ids = rng.permutation(n).astype(np.int64) * 3
        values = rng.integers(-spread, spread + 1, (n, dims))
        values[:, 0] = 4  # a constant attribute has no slice
        block = SlicedBlock.read(*SlicedBlock.build(ids, values).stored())
        for _ in range(6):
            query = rng.integers(-spread, spread + 1, dims)
            own = int(rng.choice(ids)) if rng.random() < 0.5 else -1
            got = sorted(zip(*(x.tolist() for x in block.best(own, query, 5)), strict=True), key=lambda x: (-x[1], x[0]))
            scores = values @ query
            want = sorted(
                ((int(i), int(s)) for i, s in zip(ids, scores, strict=True) if i != own), key=lambda x: (-x[1], x[0])
            )[:5]
            assert got == want


def test_search_over_blocks_and_odd_vectors(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.999]) for _ in range(6)]) for i in range(300)]
    rows += [(400, None), (None, [1.0] * 6), (450, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (500, [float("nan")] * 6)]
    rows += [(550, [float("inf")] + [0.0] * 5), (600, []), (650, [3e38] * 6), (700, [0.5, 0.5]), (50, [0.1] * 6), (51, rows[51][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = search_table(table.repartition(4), F.col("vec_id") % 50 == 0, 256.0, 5).collect()

    def q(v):
        return [int(np.floor(np.clip(np.float32(x).astype(float) * 256, -(2.0**28), 2.0**28))) for x in v]

    good = [
        (i, q(v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    asked = {}
    for i, v in good:
        if i % 50 == 0:
            asked[i] = min(asked.get(i, v), v)
    want = []
    for query_id, v in asked.items():
        scored = sorted(((sum(a * b for a, b in zip(v, w)), -i) for i, w in good if i != query_id), reverse=True)  # noqa: B905
        want += [(query_id, k, -i, s) for k, (s, i) in enumerate(scored[:5], 1)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_blocks_and_groups_give_the_same_rows(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(
        "vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("q")
    )
    queries = vectors.where("vec_id % 7 = 0")
    many = top_k(queries, build_index(vectors, rows_per_block=9), 3, per_group=2)
    one = top_k(queries, build_index(vectors), 3)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, one.collect()))


def test_empty_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert search_table(none, F.col("vec_id") % 50 == 0, 256.0, 5).collect() == []


def _slow_judge(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    fits = [
        (len(h + p), len(h), h + p, v)
        for (h, p), v in rules.items()
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    if not fits:
        return host, path, None, "allow"
    return host, path, *max(fits)[2:]


def test_urls_against_brute_force(spark):
    rules = [
        ("net", "/", "block"), ("Example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
        ("a.b", "", "block"), ("x.a.b", "/p", "allow"), ("dup.io", "/", "allow"), ("dup.io", "/", "block"), (None, "/", "block"),
    ]
    known = {}
    for h, p, v in rules:
        if h is not None:
            known[h.lower(), p] = max(v, known.get((h.lower(), p), ""))
    rng = random.Random(9)
    hosts = ["example.net", "www.EXAMPLE.net", "net", "xnet", "a.b", "x.a.b", "y.x.a.b", "example.com", "dup.io", "fr.org", "", "ä.net", "a..net"]
    tails = ["", "/", "/en/", "/en", "/en/x?y=://z", "/de/1#t", "/fr/9.html", "?q=1", "#f", "/p/q", "/é/ü"]
    urls = [None, "", "net/", "no scheme", "://net/", "http://", "a://b://net/"] + [
        f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(hosts)}{rng.choice(tails)}" for _ in range(300)
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("rule", F.lit("clash"))
    shards = build_digests(spark.createDataFrame(rules, "host string, path string, verdict string"))
    for r in judge(pages, shards).collect():
        assert (r.host, r.path, r.rule, r.verdict) == _slow_judge(r.url, known), r.url


def test_no_rules_and_no_pages(spark):
    shards = build_digests(spark.createDataFrame([], "host string, path string, verdict string"))
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id int, url string")
    assert [(r.rule, r.verdict) for r in judge(pages, shards).collect()] == [(None, "allow")]
    assert judge(pages.limit(0), shards).collect() == []


def test_equal_keys_are_told_apart_by_the_string():
    shard = DigestShard.__new__(DigestShard)
    shard.keys = np.array([5, 5, 5, 9], np.uint64)
    shard._rules, shard._verdicts = pa.chunked_array([["a/", "b/", "c/", "d/"]]), pa.chunked_array([["allow", "block", "allow", "block"]])
    found, blocked = shard.find(np.array([5, 5, 5, 9, 9, 1, 11], np.uint64), pa.array(["b/", "c/", "z/", "d/", "e/", "a/", "a/"]))
    assert found.tolist() == [True, True, False, True, False, False, False]
    assert blocked.tolist() == [True, False, False, True, False, False, False]


def test_large_components_are_exact_or_an_error(spark):
    rng = np.random.default_rng(8)
    values = np.floor(rng.uniform(-1, 1, (60, 3)) * 2.0**22)
    values[:5] = [[2.0**36, 1, 0], [-(2.0**36), 0, 1], [1, 1, 1], [2.0**21, -(2.0**21), 3], [0, 0, 0]]
    rows = [(i, v.tolist()) for i, v in enumerate(values)]
    got = search_table(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id").isin(2, 30), 1.0, 4, exact=True)
    q = [[int(x) for x in v] for v in values]
    found = {(r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()}
    want = set()
    for i in (2, 30):
        scored = sorted((-sum(a * b for a, b in zip(q[i], v, strict=True)), j) for j, v in enumerate(q) if j != i)
        want |= {(i, n, j, -s) for n, (s, j) in enumerate(scored[:4], 1)}
    assert found == want
    for big in ([1e300, 1.0, 1.0], [2.0**61, 2.0**61, 0.0]):
        two = spark.createDataFrame([(0, big), (1, big), (2, [None, 1.0, 1e300])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="does not fit"):
            search_table(two, F.col("vec_id") == 0, 1.0, 1, exact=True).collect()

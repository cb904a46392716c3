"""Parity-sketch join against all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from logrung.llm import parity_join
from logrung.llm.components import components
from logrung.llm.parity_join import Threshold, bands_of, bit_sketch, jaccard_components, one_of_each, part_keys

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _set(text, k):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def _slow(rows, k, num, den):
    """(doc_id, size, component) of each row, by comparing all pairs."""
    sets = [_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if sets[i] and sets[j] and den * common >= num * (len(sets[i]) + len(sets[j]) - common):
            root[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return sorted(
        ((d, len(s), least.get(top(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))),
        key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0),
    )


def _corpus(seed, groups=25, copies=6, passage=True):
    """Texts with copies, chains of small edits, shared passages and lone texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 4)))
    shared = [word() for _ in range(40)]
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([1, 2, 3, 8, 20, 60, 150, 400]))]
        if passage and rng.random() < 0.5:
            base = shared + base
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, copies)):
            edited = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                edited[rng.randrange(len(edited))] = word()
            texts.append(rng.choice([" ", "\n", "  "]).join(edited).replace("a", rng.choice("aA")))
            if rng.random() < 0.5:
                base = edited  # a chain: the ends need not link
    rng.shuffle(texts)
    return list(enumerate(texts, 100))


def _found(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("node", F.lit("clash"))
    got = jaccard_components(docs.repartition(4), **how).select("doc_id", "n_shingles", "component_id").collect()
    return sorted(map(tuple, got), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0))


@pytest.mark.parametrize(("seed", "words", "num", "den"), [(1, 3, 90, 100), (2, 5, 8, 10), (3, 2, 5, 10)])
def test_components_equal_all_pairs(spark, seed, words, num, den):
    rows = _corpus(seed)
    assert _found(spark, rows, words=words, num=num, den=den) == _slow(rows, words, num, den)


def test_small_blocks_and_one_large_group(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "BLOCK", 3)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(own)))
    assert _found(spark, rows, words=3, num=90, den=100) == _slow(rows, 3, 90, 100)


def test_rounds_are_small_queries_over_buckets_with_open_pairs(spark, monkeypatch, capsys):
    exchanges, udfs, open_keys, plain = [], [], [], parity_join.landed

    def watched(df, label):
        capsys.readouterr()
        df.explain()
        plan = capsys.readouterr().out
        exchanges.append((plan.count("Exchange "), label))
        udfs.append((plan.count("ArrowEvalPython"), label))
        out = plain(df, label)
        if label == "still-open":
            open_keys.append(out.select("key").distinct().count())
        return out

    monkeypatch.setattr(parity_join, "landed", watched)
    monkeypatch.setattr(parity_join, "BLOCK", 8)
    rng = random.Random(12)
    rows = []
    for i in range(150):
        own = [f"w{k}" for k in range(120)]
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(len(own))] = f"x{i}y{rng.randrange(9)}"
        rows.append((i, " ".join(own)))
    assert _found(spark, rows, words=3, num=90, den=100) == _slow(rows, 3, 90, 100)
    # The driver holds every stage of a query at once: before, one query of 30 exchanges compared the buckets.
    assert max(exchanges)[0] <= 16, max(exchanges)
    assert max(udfs) == (1, "near")
    assert len(open_keys) > 1
    assert open_keys[-1] < open_keys[0]


def _around(n, seed, edited):
    """Texts that share much and rarely link: edits of one base, or own words before a passage; every tenth has a near copy."""
    rng = random.Random(seed)
    shared = [f"w{k}" for k in range(120 if edited else 30)]
    texts = []
    for i in range(n):
        own = list(shared) if edited else [f"x{i}y{k}" for k in range(25)] + shared
        for _ in range(rng.randint(15, 40) if edited else 0):
            own[rng.randrange(len(own))] = f"x{i}y{rng.randrange(99)}"
        texts.append(own)
        if i % 10 == 0:
            texts.append([*own[:-1], f"z{i}"])
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("edited", [False, True])
def test_sets_around_something_shared_are_not_dealt_to_blocks_by_the_square(spark, monkeypatch, edited):
    dealt, plain = [], parity_join.cross_pairs

    def watched(open_, *others):
        outside = F.when(F.col("label") != F.col("big"), F.col("many")).otherwise(0)
        dealt.append(open_.select(F.sum(outside + F.col("few"))).first()[0])
        return plain(open_, *others)

    monkeypatch.setattr(parity_join, "cross_pairs", watched)
    monkeypatch.setattr(parity_join, "BLOCK", 8)
    made = {}
    for n in (100, 200):
        rows = _around(n, 14, edited)
        assert _found(spark, rows, words=3, num=80, den=100) == _slow(rows, 3, 80, 100)
        made[n] = sum(dealt)
        dealt.clear()
    assert made[200] <= 2.5 * made[100] + 50, made


def test_odd_rows(spark):
    long = " ".join(f"v{i % 7000}" for i in range(21_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  b"), (6, "a"), (7, "a b c"), (7, "a b c"), (7, "other text here now"),
        (None, "a b"), (None, None), (None, "lone words of null id"), (8, long), (9, long + " end"), (10, "é É é"), (11, "é é é"),
    ]
    assert _found(spark, rows, words=3, num=90, den=100) == _slow(rows, 3, 90, 100)
    assert _found(spark, rows[:0]) == []


def test_a_shared_key_is_emitted_by_all_linked_sets():
    rng = np.random.Generator(np.random.PCG64(6))
    for num, den in ((9, 10), (8, 10), (1, 2)):
        limit = Threshold(num, den)
        for n in [*range(1, 60), 100, 243, 700, 2000]:
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            keep = n - rng.integers(0, n - (n * num + den - 1) // den + 1)
            b = np.concatenate((a[:keep], rng.integers(0, 1 << 63, rng.integers(0, 4), dtype=np.uint64)))
            a, b = np.unique(a), np.unique(b)
            common = len(np.intersect1d(a, b))
            if not limit.links(common, len(a) + len(b)) or np.array_equal(a, b):
                continue
            both = {x.number: x for x in bands_of(len(a), limit)}.keys() & {x.number for x in bands_of(len(b), limit)}
            assert both
            assert any(
                np.intersect1d(part_keys(a, band, limit), part_keys(b, band, limit)).size
                for band in bands_of(len(a), limit)
                if band.number in both
            )
            band = next(x for x in bands_of(len(a), limit) if x.number in both)
            x, y = (np.frombuffer(bit_sketch(s, band), np.uint8) for s in (a, b))
            assert np.bitwise_count(x ^ y).sum() <= len(a) + len(b) - 2 * common


def test_components_of_paths_and_cliques(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5000), (7001, 7000)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(50)} | {7000: 7000, 7001: 7000}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
    two_roots = spark.createDataFrame([(3, 1), (3, 2), (9, 8), (9, 7), (8, 5)], "a long, b long")
    assert dict(map(tuple, components(two_roots).collect())) == {1: 1, 2: 1, 3: 1, 5: 5, 7: 5, 8: 5, 9: 5}
    rng = random.Random(2)
    for _ in range(3):
        pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
        got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect()))
        want = {}
        for a, b in pairs:
            if a != b:
                group = want.get(a, {a}) | want.get(b, {b})
                want.update(dict.fromkeys(group, group))
        assert got == {n: min(g) for n, g in want.items()}


def test_one_row_of_each_group_stays(spark):
    rows = _corpus(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit("x").alias("row"), F.lit(1).alias("id"))
    kept = one_of_each(docs, 3, 90, 100)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in _slow(rows, 3, 90, 100)})


def test_one_row_of_each_group_with_odd_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (2, text), (1, "quite another text of some words"), (None, None), (None, ""), (None, "null id words here"),
            (5, ""), (5, ""), (6, None)]
    kept = one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda r: (str(r[0]), str(r[1]))
    want = [(1, text), (1, "quite another text of some words"), (None, None), (None, ""), (None, "null id words here"), (5, ""), (5, ""), (6, None)]
    assert sorted(map(tuple, kept), key=key) == sorted(want, key=key)

"""Rank index and fill-in-the-middle against plain Python."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logrung.llm.fill_in_middle import RankIndex, fill_in_middle, restored


def _bounds(text):
    return np.cumsum([0] + [len(c.encode()) for c in text])


@pytest.mark.parametrize("most_error", [0, 3, 100])
def test_index_is_exact_and_its_error_is_bounded(most_error):
    rng = random.Random(most_error)
    runs = ["a" * 9000, "日" * 5000, "".join(rng.choices("aé日\U0001f600", k=9000)), "x", "", "ab日" * 3000 + "z" * 7000 + "é" * 7000]
    for text in [*runs, "".join(runs)]:
        bounds = _bounds(text)
        index = RankIndex(bounds, most_error, 512)
        ranks = np.arange(len(bounds))
        assert len(index) == len(bounds)
        assert np.array_equal(index.offsets(ranks), bounds)
        assert np.abs(index.predicted(ranks) - bounds).max() <= most_error
    assert len(RankIndex(_bounds("a" * 100_000)).starts) == -(-100_001 // 4096)
    assert len(RankIndex(np.zeros(0, np.int64))) == 0


def _slow(doc_id, text, fim=90, spm=20):
    text = text or ""
    n = len(text)
    if doc_id is None:
        return n, "plain", None, None, text
    digits = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h[3] % 100 < spm else "psm"
    return n, form, a, b - a, f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_outputs_and_round_trip(spark):
    rng = random.Random(4)
    pieces = ["a", "é", "日本", "\U0001f600", "<", "<P", "S>", "M>", "\n", "\x00", "é", "﻿", "word "]
    texts = [None, "", "x", "<P>", "a<S>b", "<M", "<<<", "<P" * 50, "日" * 300_000, "ab\U0001f600" * 100_000]
    texts += ["".join(rng.choices(pieces, k=rng.randint(1, 80))) for _ in range(400)]
    rows = [(i - 3 if i else None, t) for i, t in enumerate(texts)]
    rows += [(None, "no id"), rows[-1], rows[-1], (2**62, "large id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("output", F.lit("clash")).withColumn("n", F.lit(1))
    made = fill_in_middle(docs.repartition(3), slice_bytes=5000)
    got = made.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    want = sorted((str(i), *map(str, _slow(i, t)), t or "") for i, t in rows)
    assert sorted((str(r.doc_id), str(r.n), r.form, str(r.prefix_chars), str(r.middle_chars), r.output, r.back) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(docs.limit(0)).collect() == []


def test_shares_and_other_sentinels(spark):
    docs = spark.createDataFrame([(i, f"text {i} <P>") for i in range(60)], "doc_id long, text string")
    marks = ("[pre]", "[suf]", "[mid]")
    made = fill_in_middle(docs, fim_percent=100, spm_percent=100, sentinels=marks)
    got = made.withColumn("back", restored(F.col("output"), F.col("form"), marks)).collect()
    assert {r.form for r in got} == {"spm"} and all(r.back == f"text {r.doc_id} <P>" for r in got)
    assert {r.form for r in fill_in_middle(docs, fim_percent=0).collect()} == {"plain"}

"""Text statistics, rule ensemble and decision list."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from logrung.llm.decision_list import Condition, Rule, base_failed, fit, kept_rows, learn_rules, quality_table, rejecting_rule
from logrung.llm.queries import op7_rule_ensemble, op8_decision_list
from logrung.llm.rule_ensemble import fit_rows, lasso_logistic, quality_scores
from logrung.llm.text_stats import COUNTS, STATS, statistics, with_stats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    None, "", " \n\t ", "one", "a b c d e a b c d e", "x x x x x x", "Ä ö ü 日本 \U0001f600", "l1\nl1\n\n \nl1 \nl2\r\nl2\r",
    "#*$%&|<> a|b", "HELLO!!! WORLD??", "a\x0bb\x0cc\x1cd\x85e", "tail ", " head", "1 2 3 4 5 6 1 2 3 4 5 7", "w " * 30_000,
]


def _slow_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            repeated.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated))


def test_counts_equal_brute_force():
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choices("ab#é \n\n  \t", k=rng.randint(0, 80))) for _ in range(800)]
    found = statistics(pa.array(texts, pa.string()))
    got = list(zip(*(found[c].tolist() for c in COUNTS), strict=True))
    assert got == [_slow_counts(t) for t in texts]
    assert all(np.isfinite(found[s]).all() for s in STATS)


def test_slices_of_an_array_do_not_differ():
    texts = pa.array(ODD * 3, pa.string())
    whole, part = statistics(texts), statistics(texts.slice(7, 20))
    for s in STATS:
        assert part[s].tolist() == whole[s][7:27].tolist()


def test_decision_query_equals_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op8_decision_list(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _slow_counts(docs[r.doc_id])
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed and r.rule is None)


def _synthetic(n=600, seed=0):
    rng = np.random.Generator(np.random.PCG64(seed))
    rows = pd.DataFrame({s: rng.random(n) for s in STATS})
    bad = (rows["symbol_share"] > 0.7) | ((rows["upper_share"] > 0.6) & (rows["shout_share"] > 0.5))
    rows["label"] = (~bad).astype(int)
    return rows


def test_rules_find_a_planted_list():
    rules = learn_rules(_synthetic())
    fresh = _synthetic(seed=1)
    hit = np.zeros(len(fresh), bool)
    for r in rules:
        hit |= r.covers(fresh)
    assert (hit == (fresh["label"] == 0)).mean() > 0.97
    assert all(c.feature in ("symbol_share", "upper_share", "shout_share") for r in rules for c in r.conditions[:1])


def test_no_rules_without_both_labels_or_against_noise():
    rows = _synthetic()
    assert learn_rules(rows.assign(label=1)) == [] and learn_rules(rows.iloc[:0]) == []
    noise = rows.assign(label=np.random.Generator(np.random.PCG64(4)).integers(0, 2, len(rows)))
    assert all(r.precision >= 0.95 for r in learn_rules(noise))


def test_rules_are_one_ordered_conditional(spark):
    rules = [
        Rule((Condition("symbol_share", True, 0.2),)),
        Rule((Condition("n_words", False, 3.0), Condition("mean_word", True, 2.0))),
    ]
    docs = spark.createDataFrame([("###### a",), ("abc def",), ("a b c d e",), (None,)], "text string")
    got = [r[0] for r in with_stats(docs).select(rejecting_rule(rules)).collect()]
    assert got == [1, 2, None, None]
    assert [r[0] for r in with_stats(docs).select(base_failed()).collect()] == [True] * 4


def test_ensemble_learns_and_is_sparse():
    rows = _synthetic()
    model = fit_rows(rows)
    p = model.predict(_synthetic(seed=2))
    assert ((p >= 0.5) == (_synthetic(seed=2)["label"] == 1)).mean() > 0.95
    assert 0 < len(model.rules) < 80
    assert fit_rows(rows.iloc[:0]).predict(rows)[0] == 0.5
    assert fit_rows(rows.assign(label=0)).predict(rows).max() < 0.01


def test_lasso_meets_its_optimality_conditions():
    rng = np.random.Generator(np.random.PCG64(8))
    x = (rng.random((300, 12)) > 0.5).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(3 * x[:, 0] - 2 * x[:, 1])))).astype(float)
    bias, w = lasso_logistic(x, y, 0.02, rounds=5000)
    gradient = x.T @ (1 / (1 + np.exp(-(bias + x @ w))) - y) / 300
    assert np.allclose(gradient[w != 0], -0.02 * np.sign(w[w != 0]), atol=1e-4)
    assert (np.abs(gradient[w == 0]) <= 0.02 + 1e-4).all() and (w == 0).any()


def test_held_out_accuracy_and_folds(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op7_rule_ensemble(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [i for i in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in rows.items() if r.held_out} == set(held)
    judged = [i for i in held if i in labels]
    assert sum(rows[i].predicted == labels[i] for i in judged) / len(judged) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())


def _odd_tables(spark):
    plain = "eleven plain words that are all different make one document here"
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (None, "some text here"), (3, "one"), (3, "one"), (60, plain)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select(
        "doc_id", "text", F.lit("c").alias("kept"), F.lit("c").alias("row"), F.lit(9).alias("_stats"), F.lit("c").alias("rule")
    )
    labels = spark.createDataFrame(
        [(0, 1), (1, None), (2, 0), (3, 1), (3, 0), (None, 1), (8, 0), (8, 7)], "doc_id long, quality int"
    )
    return docs, labels, len(rows)


def test_odd_rows(spark):
    docs, labels, n = _odd_tables(spark)
    assert quality_table(docs, labels).count() == n
    assert quality_scores(docs, labels).count() == n
    kept = kept_rows(docs, fit(docs, labels))
    assert kept.columns == docs.columns and 0 < kept.count() < n
    none = docs.limit(0)
    assert quality_table(none, labels).count() == quality_scores(none, labels).count() == kept_rows(none, fit(none, labels)).count() == 0
    assert quality_table(docs, labels.limit(0)).count() == n
    # A bound below the table's size draws, and still fits.
    assert quality_scores(docs, labels, limit=1).count() == n

"""Kneser-Ney models and language identification."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logrung.llm.draws import RANGE, draw, share
from logrung.llm.language_id import KneserNey, _load, _suffix, accepted_rows, char_codes, four_grams, language_table, train
from logrung.llm.queries import op9_language_id


def test_codes():
    assert len(char_codes("")) == len(char_codes("12 ... \n")) == len(four_grams(None)) == 0
    assert char_codes("  Ab-12 c").tolist() == [0, 0, 0, ord("a"), ord("b"), 0, ord("c"), 0]
    assert char_codes("\U00010400 \U0001f600x").tolist() == [0, 0, 0, 0xFFFF, 0, ord("x"), 0]
    assert len(char_codes("½²_")) == 0


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcd", [8, 4, 2, 1], k=rng.randint(1, 6))) for _ in range(400))
    keys, counts = np.unique(four_grams(text), return_counts=True)
    return KneserNey.build(keys, counts, 6), keys, counts


def test_probabilities_of_each_history_sum_to_one(model):
    kn, keys, _ = model
    alphabet = np.array([0, *map(ord, "abcd"), ord("z")], np.uint64)
    seen = np.unique(keys >> np.uint64(16))
    unseen = np.array([ord("z") << 32 | ord("z") << 16 | ord("z"), ord("z") << 32 | ord("a"), ord("d") << 32 | ord("d") << 16], np.uint64)
    for history in np.concatenate((seen[:40], unseen)):
        p = np.exp(kn.log_p((history << np.uint64(16)) | alphabet))
        assert abs(p.sum() - 1) < 1e-4


def test_equals_the_textbook_recursion(model):
    kn, keys, counts = model
    tables = [dict(zip(keys.tolist(), counts.tolist(), strict=True))]
    for order in (3, 2, 1):
        low = {}
        for k in tables[-1]:
            s = int(_suffix(np.array([k], np.uint64), order)[0])
            low[s] = low.get(s, 0) + 1
        tables.append(low)
    tables.reverse()

    def p(key, order):
        if order == 0:
            return 1 / 6
        table = tables[order - 1]
        once, twice = (sum(c == n for c in table.values()) for n in (1, 2))
        d = once / (once + 2 * twice) if once else 0.5
        own = [c for k, c in table.items() if k >> 16 == key >> 16]
        lower = p(key & ((1 << 16 * (order - 1)) - 1), order - 1)
        if not own:
            return lower
        return max(table.get(key, 0) - d, 0) / sum(own) + d * len(own) / sum(own) * lower

    rng = random.Random(4)
    probes = [int(k) for k in keys[:60]] + [
        sum(rng.choice([0, *map(ord, "abcdz")]) << 16 * i for i in range(4)) for _ in range(60)
    ]
    got = np.exp(kn.log_p(np.array(probes, np.uint64)))
    assert np.allclose(got, [p(k, 4) for k in probes], rtol=1e-4)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op9_language_id(spark, sf).collect()
    assert {r.doc_id for r in rows if r.held_out} == {i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2}
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.99
    assert sum(r.accepted for r in rows) / len(rows) > 0.995


def test_foreign_text_is_rejected_and_odd_rows_are_kept_apart(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", F.lit("c").alias("score"), F.lit("c").alias("row"))
    rng = random.Random(3)
    junk = " ".join("".join(rng.choices("qxzjwkvбгд", k=7)) for _ in range(200))
    odd = [
        (90001, None, "en"), (90002, "", "en"), (90003, "12 -- 3", "de"), (90004, junk, None), (90005, "日本語" * 50, None),
        (None, "The and of", "en"), (90006, "e", None), (90007, "É" * 100_000, None),
    ]
    both = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string").selectExpr("*", "'c' score", "'c' row"))
    found = {r.doc_id: r for r in language_table(both).collect()}
    assert all(found[i].lang_pred == "und" and not found[i].accepted and found[i].score == 0 for i in (90001, 90002, 90003))
    assert not found[90004].accepted and not found[90005].accepted
    assert found[90006].lang_pred in ("en", "de", "fr", "es") and None in found
    kept = accepted_rows(both)
    assert kept.columns == both.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert not ids & {90001, 90002, 90003, 90004, 90005}


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en"), (4, "...", "en")], "doc_id long, text string, lang string")
    rows = language_table(docs).collect()
    assert [r.lang_pred for r in rows] == ["und"] * 3 and not any(r.accepted for r in rows)
    assert language_table(docs.limit(0)).collect() == []
    assert accepted_rows(docs.limit(0)).collect() == []


@pytest.mark.parametrize("n_rare", [1, 3, 60])
def test_a_rare_language_does_not_take_in_foreign_text(spark, n_rare):
    rng = random.Random(5)
    rare = ["".join(rng.choices("оаеинтсрвл", k=rng.randint(2, 5))) for _ in range(60)]
    rare_text = lambda n: " ".join(rng.choices(rare, k=n))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    junk = [" ".join("".join(rng.choices(letters, k=7)) for _ in range(200)) for letters in ("qxzjwkvбгд", "日本語中文字", "ωψχφυτσ")]
    learned = [i for i in range(80_000, 81_000) if zlib.crc32(str(i).encode()) % 4 != 2][:n_rare]
    odd = [(i, rare_text(150), "xx") for i in learned] + [(90_000 + i, x, None) for i, x in enumerate(junk)] + [(95_000, rare_text(150), None)]
    both = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    found = {r.doc_id: r for r in language_table(both).collect()}
    assert [found[90_000 + i].accepted for i in range(3)] == [False] * 3
    assert found[95_000].lang_pred == "xx" and found[95_000].accepted
    assert sum(r.accepted for r in found.values()) / len(found) > 0.99


def test_every_language_has_a_limit(spark):
    texts = [(i, f"some words of a small table number {'abcdefghij'[i % 10] * 3}", "en") for i in range(8)] + [(9, "ein Text", "de")]
    path = train(spark.createDataFrame(texts, "doc_id long, text string, lang string"), F.lit(True))
    langs, models = _load(path)
    assert langs == ["de", "en"] and all(np.isfinite(m.limit) for m in models)


def test_draws_hold_at_any_size(spark):
    for n in (10, 4_001, 10**7, 10**10, 10**18, 10**30):
        assert 0 < share(4_000, n) <= RANGE and (n <= 4_000) == (share(4_000, n) == RANGE)
        if 4_000 < n < 10**15:
            assert abs(share(4_000, n) / RANGE * n - 4_000) < 1
    drawn = spark.range(100_000).where(draw("id") < share(2_000, 100_000)).count()
    assert abs(drawn - 2_000) < 250 and spark.range(1000).where(draw("id") < RANGE).count() == 1000

"""Licence scan against a plain reading of the same texts."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from logrung.llm.license_scan import BASE_PHRASES, NOTICE_PHRASES, LicenceScanner, parse_expression, scan_licences
from logrung.llm.queries import op12_license_scan


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def _slow(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(text))

    def places(phrases):
        return sorted(
            (i, label)
            for phrase, label in phrases
            for i in range(len(words))
            if words[i : i + len(phrase.split())] == phrase.split()
        )

    base = places(BASE_PHRASES)
    labels = {n for _, n in base}
    found = labels | {n for _, n in places(NOTICE_PHRASES)}
    return (
        len(words),
        len(base),
        base[0][0] if base else None,
        base[-1][0] if base else None,
        ",".join(sorted(labels)),
        ",".join(sorted(found)),
    )


def test_phrases_against_brute_force(spark):
    rng = random.Random(2)
    pool = ["MIT", "license", "Licence", "apache", "GENERAL", "public", "lesser", "gnu", "bsd", "3", "clause", "ı", "K", "ﬁ", "é", "x"]
    gaps = [" ", "-", "\n", ", ", " (", "\x00", " ", ""]
    texts = [None, "", " ", "MIT", "mit license mit license", "mit license", "SMIT LICENSE", "MİT License", "-MIT LICENSE-"]
    texts += ["".join(rng.choice(pool) + rng.choice(gaps) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    texts += [" ".join(p for p, _ in BASE_PHRASES + NOTICE_PHRASES), "general public license " * 40_000]
    rows = list(enumerate(texts)) + [(None, "the MIT license"), (5, texts[5]), (5, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit("clash"))
    got = scan_licences(docs.repartition(3), slice_bytes=3000).collect()
    want = sorted(str((i, *_slow(t))) for i, t in rows)
    assert sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels)) for r in got) == want
    assert all((r.score > 0) == bool(r.labels) == bool(r.places) and 0 <= r.score <= 1 for r in got)
    assert scan_licences(docs.limit(0)).collect() == []


@pytest.mark.parametrize(
    ("text", "postfix", "labels", "duty"),
    [
        ("mit", "mit", "mit", 0),
        ("mit or apache-2.0 and gpl-2.0-only", "mit apache-2.0 gpl-2.0-only and or", "apache gpl mit", 0),
        ("(mit or apache-2.0) and gpl-2.0+", "mit apache-2.0 or gpl-2.0+ and", "apache gpl mit", 2),
        ("gpl-2.0-or-later with classpath-exception-2.0 and mpl-2.0", "gpl-2.0-or-later classpath-exception-2.0 with mpl-2.0 and", "gpl mpl", 1),
        ("mit and isc and zlib", "mit isc and zlib and", "isc mit zlib", 0),
        ("agpl-3.0-only or cc-by-nc-4.0", "agpl-3.0-only cc-by-nc-4.0 or", "agpl cc-by-nc", 2),
        ("((bsd-3-clause))", "bsd-3-clause", "bsd", 0),
        ("mit and you may use it", "mit", "mit", 0),
        ("mit or (apache-2.0", "mit", "mit", 0),
        ("mit with mit with mit", "mit mit with", "mit", 0),
        ("(mit or isc) with x", "mit isc or", "isc mit", 0),
        ("mit\nor isc", "mit", "mit", 0),
        ("mit.", "mit", "mit", 0),
    ],
)
def test_expressions(text, postfix, labels, duty):
    found = parse_expression(text)
    assert (" ".join(found.postfix), " ".join(sorted(found.labels)), found.duty) == (postfix, labels, duty)


@pytest.mark.parametrize("text", ["", "see below", "and mit", ") mit", "(", "(mit", "mitt", "with mit", "mit-style"])
def test_no_expression(text):
    assert parse_expression(text) is None


def test_random_expressions_against_python():
    rng = random.Random(8)
    ids = {"mit": 0, "mpl-2.0": 1, "gpl-3.0": 2, "cc-by-nc-4.0": 3}

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            name = rng.choice(list(ids))
            duty = ids[name]
            if rng.random() < 0.2:
                return f"{name} with extra-1.0", f"({1 if duty == 2 else duty})"
            return name, f"({duty})"
        a, b = make(depth - 1), make(depth - 1)
        if rng.random() < 0.5:
            return f"({a[0]}) and ({b[0]})", f"max({a[1]}, {b[1]})"
        return f"({a[0]}) or {b[0]}" if " and " not in b[0] and " or " not in b[0] else f"({a[0]}) or ({b[0]})", f"min({a[1]}, {b[1]})"

    for _ in range(300):
        text, code = make(4)
        found = parse_expression(text)
        assert found.end == len(text) and found.duty == eval(code), text


def test_tags(spark):
    rows = [
        (1, "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause\nint x;", "apache,bsd,mit", ["mit apache-2.0 or bsd-3-clause and"], 0),
        (2, '{"name": "x", "license": "GPL-3.0-only"}', "gpl", ["gpl-3.0-only"], 2),
        (3, "License: see the file", "", [], None),
        (4, "my-license: MIT", "", [], None),
        (5, "License:\nMIT", "", [], None),
        (6, "Licence: MIT. The GNU General Public License does not apply.", "gpl,mit", ["mit"], 2),
    ]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.expressions, r.obligation) for r in scan_licences(docs).collect()}
    assert got == {r[0]: r[2:] for r in rows}


def test_long_runs_take_linear_time():
    scanner = LicenceScanner()
    began = time.perf_counter()
    for text in ("license: mit or " * 60_000, "license: " + "(" * 1_000_000, "license: mit" + " or mit" * 150_000, "license:" * 120_000):
        scanner.expressions(text)
    assert time.perf_counter() - began < 20


def test_query_equals_brute_force(spark, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:7] for r in op12_license_scan(spark, sf).collect()}
    assert got == {r.doc_id: _slow(r.text) for r in texts}

"""Masks and the strict parse: the plain patterns' results, also on lines of a megabyte."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from logrung.functions import parsing
from logrung.functions.masking import mask_rule, with_masked
from logrung.functions.parsing import parse_lines, parse_loose, parse_strict

# The plain forms, as Python patterns. The class rule keeps to ASCII names in both.
PLAIN = {
    "class": (r"\b(?:[a-zA-Z0-9_]+\.)+[A-Z][a-zA-Z0-9_]+\b", "<CLASS_NAME>"),
    "composite": (r"\b\d+(?:_\d+)+\b", "<COMPOSITE_ID>"),
}


@pytest.mark.parametrize("rule", sorted(PLAIN))
def test_masks_equal_the_plain_patterns(spark, rule):
    rng = random.Random(17)
    pieces = ["a", "B", "Bc", ".", "..", "_", "1", "12", " ", "é", "-", "x.Y", "com.acme.Foo", "1_2", "a1_", ":", "\n"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(10_000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.m for r in rows.select("i", mask_rule(F.col("t"), rule).alias("m")).collect()}
    pattern, placeholder = PLAIN[rule]
    for i, text in enumerate(texts):
        assert got[i] == re.sub(pattern, placeholder, text), text


def test_megabyte_tokens_do_not_end_the_executor(spark):
    n = 1_000_000
    texts = ["a." * (n // 2), "a." * (n // 2) + "Zed", "1_" * (n // 2) + "1", "1_" * (n // 2) + "x", "." * n, "f" * n, "é" + "a." * (n // 2), "[x" * (n // 2) + "]"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, message string")
    got = {r.i: r.masked for r in with_masked(rows, "message", "masked").collect()}
    assert got[0] == texts[0] and got[1] == "<CLASS_NAME>" and got[2] == "<COMPOSITE_ID>" and got[5] == "<HEX>"


def _pieces(rng, n):
    parts = [
        "I ", "info", "INFO ", "WARN", "E", ":", "---", " - ", "]", "[", "x", "abc ", " ", "\t", "-", "5", "Z", "é",
        "2024-01-02 03:04:05", "2024-01-02T03:04:05,123 ", "2024-01-02 03:04:05.9Z", "2024-01-02 03:04:05 +0200 ", "2024-01-0",
    ]
    return "".join(rng.choices(parts, k=n))


def test_strict_parse_in_steps_equals_the_one_pattern(spark, monkeypatch):
    rng = random.Random(23)
    lines = ["", " ", ":", "I:", "error: x", "2024-01-02 03:04:05Zerror: x"] + [_pieces(rng, rng.randint(1, 14)) for _ in range(20_000)]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, line string").repartition(8)
    found = {}
    for name, limit in (("one", 10**9), ("steps", -1)):
        monkeypatch.setattr(parsing, "LONG_LINE", limit)
        found[name] = {r.i: r.p for r in parse_strict(rows, "line", "p").select("i", "p").collect()}
    for i, line in enumerate(lines):
        assert found["one"][i] == found["steps"][i], line


def test_megabyte_lines_parse_in_seconds(spark):
    stamp = "2024-01-02 03:04:05 "
    lines = ["I " * 500_000, ": " + "I " * 500_000, stamp * 50_000, stamp * 50_000 + "INFO : end", "I " * 400_000 + ": tail", "x" * 1_000_000 + " ERROR: y"]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, raw_line string")
    start = time.time()
    got = {r.i: r for r in parse_strict(rows, "raw_line", "p").collect()}
    assert time.time() - start < 60
    assert got[0].p is None and got[2].p is None and got[1].p is None
    assert got[3].p.line_level == "INFO" and got[3].p.message == "end" and got[3].p.line_timestamp.strip() == stamp.strip()
    assert got[4].p.line_level == "I" and got[4].p.message == "tail"
    assert got[5].p.message == "y"
    assert parse_lines(rows.where("i in (4, 5)"), "raw_line").count() == 2


def test_loose_parse_in_steps_equals_the_one_pattern(spark, monkeypatch):
    rng = random.Random(29)
    parts = [
        "R02-M1 ", "AB ", " AB", "INFO ", "WARN", "\t", " ", "  ", "Z", "Z ", "x", "é", "KERNEL INFO ", "5 ", " FATAL x", "+0200", ",123",
        "2024-01-02 03:04:05", "2024-01-02T03:04:05,123 ", "2024-01-02 03:04:05.9Z", "2024-01-02 03:04:05 +0200 ", "2024-01-02 03:04:05  ", "2024-01-0",
    ]
    lines = ["", "AB INFO x", " AB INFO x", "2024-01-02 03:04:05 AB INFO x", "2024-01-02 03:04:05 ZONE INFO x", "2024-01-02 03:04:05 AB INFO x CD WARN y"]
    lines += ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(20_000)]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, line string").repartition(8)
    found = {}
    for name, limit in (("one", 10**9), ("steps", -1)):
        monkeypatch.setattr(parsing, "LONG_LINE", limit)
        found[name] = {r.i: r.p for r in parse_loose(rows, "line", "p").select("i", "p").collect()}
    assert sum(p is not None for p in found["one"].values()) > 2000
    for i, line in enumerate(lines):
        assert found["one"][i] == found["steps"][i], line


def test_megabyte_lines_parse_loosely_in_seconds(spark):
    stamp = "2024-01-02 03:04:05 "
    lines = [stamp * 50_000, stamp * 50_000 + "AB INFO end", "AB " * 330_000, "AB " * 330_000 + "INFO tail", "A" * 1_000_000, "AB" + " " * 1_000_000, "AB INFO" * 140_000]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, raw_line string")
    start = time.time()
    got = {r.i: r.p for r in parse_loose(rows, "raw_line", "p").collect()}
    assert time.time() - start < 60
    assert got[0] is None and got[2] is None and got[4] is None and got[5] is None and got[6] is None
    assert (got[1].line_level, got[1].message) == ("INFO", "end") and (got[3].line_level, got[3].message) == ("INFO", "tail")

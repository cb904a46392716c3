"""Scans, counters and exports on small files."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from logrung.operators.sampling import assign_chunks
from logrung.plans.corpus import build_corpus
from logrung.sources import files, sinks


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.json").write_text(
        json.dumps([{"line": "INFO: hi", "timestamp": "t1", "fields": {"app": "x", "odd": 1}}, 5, {"line": "bare"}])
    )
    (tmp_path / "b.json").write_text(json.dumps({"line": "INFO: not in an array"}))
    (tmp_path / "c.json").write_text('[{"line": "cut"')
    (tmp_path / "d.json").write_text("[1, 2]")
    (tmp_path / "e.json").write_text(json.dumps([{"line": 7}, {"line": None}, {"fields": None}]))
    (tmp_path / "t.log").write_bytes("a\x0bb\r\nc d\n\n   \n".encode() + b"e\xff\n")
    (tmp_path / "sub" / "X.LOG").write_text("WARN: upper suffix\n")
    (tmp_path / "x.txt").write_text("ignored\n")
    return str(tmp_path)


def test_discovery(spark, folder):
    names = [os.path.basename(r.file_path) for r in files.discover_files(spark, folder).collect()]
    assert names == ["a.json", "b.json", "c.json", "d.json", "e.json", "X.LOG", "t.log"]
    some = files.discover_files(spark, folder, r"^[abt]\.").collect()
    assert sorted(os.path.basename(r.file_path) for r in some) == ["a.json", "b.json", "t.log"]
    with pytest.raises(FileNotFoundError):
        files.discover_files(spark, folder + "/missing")
    with pytest.raises(FileNotFoundError):
        files.scan_text(spark, folder + "/missing")


def test_text_lines(spark, folder):
    rows = files.scan_text(spark, folder, r"^t\.").orderBy("file_path", "block", "pos").collect()
    assert [r.raw_line for r in rows] == ["a", "b", "c", "d", "e�"]


def test_json_records_and_counters(spark, folder):
    counters = {os.path.basename(r.file_path): r for r in files.load_counters(spark, folder).collect()}
    assert (counters["a.json"].status, counters["a.json"].kept, counters["a.json"].dropped) == ("ok", 2, 1)
    assert [counters[n].status for n in ("b.json", "c.json", "d.json")] == ["not_array", "malformed", "empty"]
    rows = files.scan_parsed(spark, folder, r"\.json$").orderBy("file_path", "pos").collect()
    assert [(r.raw_line, r.line_level, r.message) for r in rows] == [
        ("INFO: hi", "INFO", "hi"), ("bare", "UNKNOWN", "bare"), ("", "UNKNOWN", ""),
    ]
    assert rows[0].metadata.app == "x" and rows[0].metadata.pod == "" and rows[0].log_timestamp == "t1"
    refused = files.rejected_records(spark, folder).collect()
    assert len(refused) == 2 and {r.reject_reason for r in refused} == {"line is not a string"}


def test_directory(spark, folder):
    rows = files.scan_directory(spark, folder)
    assert {r.dataset for r in rows.select("dataset").distinct().collect()} == {"a", "e", "t", "sub"}
    counts = files.scan_counts(rows).first()
    assert (counts.entries, counts.files) == (9, 4)


def test_chunks(spark, tmp_path):
    rows = spark.range(25).select("id", F.concat(F.lit("line "), "id", F.lit(" x\n y  ")).alias("raw_line"))
    chunked = assign_chunks(rows, ["id"], 10)
    written = sinks.write_chunks(chunked, str(tmp_path / "out.log"))
    assert [os.path.basename(p) for p in written] == ["out_001.log", "out_002.log", "out_003.log"]
    content = [open(p).read().splitlines() for p in written]
    assert [len(c) for c in content] == [10, 10, 5]
    order = [r.id for r in chunked.orderBy("position").collect()]
    assert [int(line.split()[1]) for c in content for line in c] == order
    assert all(line.endswith("x  y") for c in content for line in c)
    assert order != sorted(order)
    with pytest.raises(ValueError):
        assign_chunks(rows, ["id"], 0)


def test_corpus_job(spark, tmp_path):
    for name, n in (("big", 300), ("small", 7)):
        (tmp_path / "src" / name).mkdir(parents=True)
        lines = [f"{'ERROR' if i % 3 == 0 else 'INFO'}: message {i}" for i in range(n)]
        (tmp_path / "src" / name / "x.log").write_text("\n".join(lines) + "\n")
    built = build_corpus(spark, str(tmp_path / "src"), str(tmp_path / "out" / "mini"), total=61, lines_per_file=20)
    assert built.sampled == 31 + 7 and built.shortfall == 23
    quotas = {(r.dataset, r.level): r.quota for r in built.quotas.collect()}
    assert quotas[("big", "ERROR")] + quotas[("big", "INFO")] == 31
    assert quotas[("small", "ERROR")] == 3 and quotas[("small", "INFO")] == 4
    files_out = sorted(glob.glob(str(tmp_path / "out" / "*.log")))
    assert files_out == built.files and len(files_out) == 2
    lines = [line for f in files_out for line in open(f).read().splitlines()]
    assert len(lines) == 38
    with pytest.raises(FileNotFoundError):
        build_corpus(spark, str(tmp_path / "nowhere"), str(tmp_path / "o"))


def test_run_metrics_and_templates_roundtrip(spark, tmp_path):
    table = spark.createDataFrame([("r", "m", "accuracy", "", 1.0)], "run_id string, model string, metric string, label string, value double")
    sinks.write_run_metrics(table, str(tmp_path / "metrics"))
    sinks.write_run_metrics(table, str(tmp_path / "metrics"))
    assert spark.read.parquet(str(tmp_path / "metrics")).count() == 2
    templates = spark.createDataFrame([(1, "a <*>")], "template_id long, template string")
    sinks.save_templates(templates, str(tmp_path / "templates"))
    assert sinks.load_templates(spark, str(tmp_path / "templates")).collect() == templates.collect()

"""Queries on file scans, budgets, samples, chunks and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from logrung import fixtures
from logrung.catalog import sql
from logrung.catalog.base import landed, masked_logs, parsed_logs, query, scored_rows, staged_logs, staged_records
from logrung.functions.levels import level_id
from logrung.operators import sampling
from logrung.operators.metrics import is_wrong
from logrung.plans.train import training_rows
from logrung.sources import files

# A budget that some datasets cannot fill at small scale and that rounds.
_TOTAL = 4003

_LINES = f"""{sql.WITH_LOGV}, text_lines AS (SELECT dataset, unnest(string_split(line, chr(10))) AS raw_line FROM logv)"""


@query("scan_text", f"{_LINES} SELECT dataset, raw_line FROM text_lines WHERE {sql.trimmed('raw_line')} <> ''")
def _(spark, sf):
    from logrung.functions.text import dataset_key

    root = staged_logs(spark, sf)
    return files.scan_text(spark, root).select(dataset_key(F.col("file_path"), root).alias("dataset"), "raw_line")


@query(
    "scan_json",
    f"""{sql.WITH_LOGV} SELECT dataset, CAST(event_id AS VARCHAR) AS log_timestamp, line AS raw_line, dataset AS app, detected_level FROM logv""",
)
def _(spark, sf):
    from logrung.functions.text import dataset_key
    from logrung.sources.records import project_records

    root = staged_records(spark, sf)
    rows = project_records(files.scan_json(spark, root), "raw_json")
    return rows.select(
        dataset_key(F.col("file_path"), root).alias("dataset"),
        "log_timestamp", "raw_line", "metadata.app", "metadata.detected_level",
    )


@query(
    "discover_files",
    f"""{sql.WITH_LOGV} SELECT concat(dataset, '/part-', CAST(event_id // 5000 AS VARCHAR), '.json') AS file, 'json' AS kind
        FROM logv GROUP BY 1 HAVING regexp_matches(file, 'part-[0-9]*[02468]\\.json')""",
)
def _(spark, sf):
    root = staged_records(spark, sf)
    found = files.discover_files(spark, root, r"part-[0-9]*[02468]\.")
    return found.select(F.substring_index("file_path", "/", -2).alias("file"), "kind")


@query(
    "scan_directory_counts",
    f"""{_LINES}, per AS (SELECT concat(dataset, '/text') AS f FROM text_lines WHERE {sql.trimmed('raw_line')} <> ''
          UNION ALL SELECT concat(dataset, '/', CAST(event_id // 5000 AS VARCHAR)) FROM logv)
        SELECT count(*) AS entries, count(DISTINCT f) AS files FROM per""",
)
def _(spark, sf):
    text = files.scan_directory(spark, staged_logs(spark, sf)).select("file_path", "raw_line")
    # A file is one dataset's text; its parts count once.
    text = text.withColumn("file_path", F.regexp_replace("file_path", r"/app(-\d+)?\.log$", "/text"))
    records = files.scan_directory(spark, staged_records(spark, sf)).select("file_path", "raw_line")
    return files.scan_counts(text.unionByName(records))


@query(
    "load_counters",
    f"""{sql.WITH_LOGV} SELECT concat(dataset, '/part-', CAST(event_id // 5000 AS VARCHAR), '.json') AS file, 'ok' AS status,
        CAST(count(*) AS INTEGER) AS items, CAST(count(*) AS INTEGER) AS kept, 0 AS dropped FROM logv GROUP BY 1""",
)
def _(spark, sf):
    counters = files.load_counters(spark, staged_records(spark, sf))
    return counters.select(
        F.substring_index("file_path", "/", -2).alias("file"), "status", "items", "kept", "dropped"
    )


_COUNTS = """counts AS (SELECT dataset, upper(line_level) AS level, count(*) AS n FROM parsed WHERE raw_line <> '' GROUP BY 1, 2)"""
_BUDGETS = f"""budgets AS (SELECT dataset, {_TOTAL} // c + CASE WHEN place <= {_TOTAL} % c THEN 1 ELSE 0 END AS budget
 FROM (SELECT dataset, row_number() OVER (ORDER BY dataset) AS place, count(*) OVER () AS c FROM (SELECT DISTINCT dataset FROM counts)))"""
_QUOTAS = """shares AS (SELECT *, floor(share) AS whole, share - floor(share) AS remainder FROM (
   SELECT *, least(budget, total) * n / total AS share FROM (
    SELECT *, sum(n) OVER (PARTITION BY dataset) AS total FROM counts JOIN budgets USING (dataset)))),
 quotas AS (SELECT dataset, level, n, budget, CAST(least(n, whole + CASE WHEN place <= leftover THEN 1 ELSE 0 END) AS BIGINT) AS quota FROM (
   SELECT *, least(budget, total) - sum(whole) OVER (PARTITION BY dataset) AS leftover,
     row_number() OVER (PARTITION BY dataset ORDER BY remainder DESC, level DESC) AS place FROM shares))"""
_SAMPLED = """sampled AS (SELECT * FROM (SELECT event_id, dataset, upper(line_level) AS level, raw_line,
   row_number() OVER (PARTITION BY dataset, upper(line_level) ORDER BY md5(concat('42:', CAST(event_id AS VARCHAR)))) AS place
   FROM parsed WHERE raw_line <> '') JOIN quotas USING (dataset, level) WHERE place <= quota)"""
_SAMPLING = f"{sql.WITH_PARSED}, {_COUNTS}, {_BUDGETS}, {_QUOTAS}"


def _counts(spark, sf):
    return sampling.level_counts(parsed_logs(spark, sf))


def _quotas(counts):
    return sampling.level_quotas(counts, sampling.dataset_budgets(counts, _TOTAL))


@query("level_counts", f"{sql.WITH_PARSED}, {_COUNTS} SELECT dataset, level, n FROM counts")
def _(spark, sf):
    return _counts(spark, sf)


@query("dataset_budgets", f"{_SAMPLING} SELECT dataset, CAST(budget AS BIGINT) AS budget FROM budgets")
def _(spark, sf):
    return sampling.dataset_budgets(_counts(spark, sf), _TOTAL)


@query("level_quotas", f"{_SAMPLING} SELECT dataset, level, n, quota FROM quotas")
def _(spark, sf):
    return _quotas(landed(_counts(spark, sf), "level-counts")).select("dataset", "level", "n", "quota")


@query("stratified_sample", f"{_SAMPLING}, {_SAMPLED} SELECT event_id, dataset, level, raw_line FROM sampled")
def _(spark, sf):
    from logrung.plans.corpus import balanced_sample

    _, sample = balanced_sample(parsed_logs(spark, sf), ("event_id",), _TOTAL)
    return sample.select("event_id", "dataset", "level", "raw_line")


@query(
    "chunk_assign",
    f"""{sql.WITH_LOGV} SELECT event_id, place AS position, lpad(CAST((place - 1) // 1500 + 1 AS VARCHAR), 3, '0') AS chunk
        FROM (SELECT event_id, row_number() OVER (ORDER BY md5(concat('42:', CAST(event_id AS VARCHAR)))) AS place FROM logv)""",
)
def _(spark, sf):
    chunked = sampling.assign_chunks(fixtures.logv(spark, sf), ("event_id",), 1500)
    return chunked.select("event_id", "position", "chunk")


@query(
    "class_counts",
    f"""{sql.WITH_PARSED} SELECT {sql.class_id('line_level')} AS label, count(*) AS n, count(*) >= 4 AS kept FROM parsed
        WHERE {sql.class_id('line_level')} IS NOT NULL GROUP BY 1""",
)
def _(spark, sf):
    rows = parsed_logs(spark, sf).select(level_id(F.col("line_level")).alias("label"))
    return sampling.class_counts(rows.filter("label IS NOT NULL"))


# Values of one cent each make rare classes: many users have fewer than four.
@query(
    "drop_rare",
    "SELECT event_id, bin FROM (SELECT event_id, CAST(floor(value) AS INTEGER) AS bin, count(*) OVER (PARTITION BY floor(value)) AS n FROM events) WHERE n >= 4",
)
def _(spark, sf):
    rows = fixtures.table(spark, sf, "events").select("event_id", F.floor("value").cast("int").alias("bin"))
    return sampling.drop_rare(rows, sampling.class_counts(rows, "bin"), "bin")


_SPLIT = f"""rows AS (SELECT event_id, {sql.class_id('line_level')} AS label FROM parsed WHERE {sql.class_id('line_level')} IS NOT NULL),
 sizes AS (SELECT label, count(*) AS n FROM rows GROUP BY 1 HAVING count(*) >= 4),
 held AS (SELECT *, CAST(whole + CASE WHEN row_number() OVER (ORDER BY share - whole DESC, label) <= budget - sum(whole) OVER () THEN 1 ELSE 0 END AS BIGINT) AS h
   FROM (SELECT *, floor(share) AS whole FROM (SELECT *, budget * n / sum(n) OVER () AS share
     FROM (SELECT *, ceil(sum(n) OVER () * 0.2) AS budget FROM sizes)))),
 tests AS (SELECT label, n, h, CAST(whole2 + CASE WHEN row_number() OVER (ORDER BY share2 - whole2 DESC, label) <= budget2 - sum(whole2) OVER () THEN 1 ELSE 0 END AS BIGINT) AS t
   FROM (SELECT *, floor(share2) AS whole2 FROM (SELECT *, budget2 * h / sum(h) OVER () AS share2
     FROM (SELECT *, ceil(sum(h) OVER () * 0.5) AS budget2 FROM held))))"""


@query(
    "split_sizes",
    f"{sql.WITH_PARSED}, {_SPLIT} SELECT label, n, n - h AS n_train, h - t AS n_validation, t AS n_test FROM tests",
)
def _(spark, sf):
    rows = parsed_logs(spark, sf).select(level_id(F.col("line_level")).alias("label"))
    counts = sampling.class_counts(rows.filter("label IS NOT NULL"))
    return sampling.split_sizes(landed(counts, "class-counts"))


@query(
    "stratified_split",
    f"""{sql.WITH_PARSED}, {_SPLIT} SELECT event_id, label, CASE WHEN place <= n - h THEN 'train' WHEN place <= n - t THEN 'validation' ELSE 'test' END AS split
        FROM (SELECT event_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat('94:', CAST(event_id AS VARCHAR)))) AS place FROM rows)
        JOIN tests USING (label)""",
)
def _(spark, sf):
    rows = parsed_logs(spark, sf).select("event_id", level_id(F.col("line_level")).alias("label"))
    labelled = landed(rows.filter("label IS NOT NULL"), "labelled")
    return sampling.stratified_split(labelled, ["event_id"]).select("event_id", "label", "split")


@query(
    "uniform_sample",
    f"{sql.WITH_LOGV} SELECT event_id, line FROM logv ORDER BY md5(concat('94:', CAST(event_id AS VARCHAR))) LIMIT 3000",
)
def _(spark, sf):
    return sampling.uniform_sample(fixtures.logv(spark, sf), 3000, ["event_id"]).select("event_id", "line")


@query(
    "bench_sample",
    f"""{sql.WITH_PARSED} SELECT event_id, message, upper(line_level) AS true_label FROM parsed WHERE upper(line_level) <> 'UNKNOWN'
        ORDER BY md5(concat('94:', CAST(event_id AS VARCHAR))) LIMIT 2500""",
)
def _(spark, sf):
    from logrung.plans.benchmark import benchmark_rows

    return benchmark_rows(parsed_logs(spark, sf), ["event_id"], 2500).select("event_id", "message", "true_label")


@query(
    "head_usable",
    f"""{sql.WITH_MASKED} SELECT event_id, masked AS text, {sql.class_id('line_level')} AS label FROM masked
        WHERE {sql.class_id('line_level')} IS NOT NULL ORDER BY dataset, event_id LIMIT 2000""",
)
def _(spark, sf):
    # The slice keeps the buckets small; it does not change the order.
    rows = parsed_logs(spark, sf).withColumn("slice", F.expr("event_id div 1000"))
    return training_rows(rows, ["event_id"], 2000, ["dataset", "slice"], ["event_id"])


@query(
    "error_sample",
    f"""{sql.WITH_SCORED} SELECT event_id, true_label, predicted_label, confidence FROM scored
        WHERE true_label <> predicted_label AND true_label <> 'UNKNOWN' ORDER BY md5(concat('94:', CAST(event_id AS VARCHAR))) LIMIT 10""",
)
def _(spark, sf):
    wrong = scored_rows(spark, sf).filter(is_wrong())
    return sampling.display_sample(wrong, 10, ["event_id"]).select(
        "event_id", "true_label", "predicted_label", "confidence"
    )


@query(
    "input_sample",
    f"{sql.WITH_MASKED} SELECT event_id, masked AS message FROM masked ORDER BY md5(concat('94:', CAST(event_id AS VARCHAR))) LIMIT 30",
)
def _(spark, sf):
    rows = masked_logs(spark, sf).select("event_id", F.col("masked").alias("message"))
    return sampling.display_sample(rows, 30, ["event_id"])

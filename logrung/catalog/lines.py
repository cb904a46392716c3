"""Queries on parsing, masking and label functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from logrung import fixtures
from logrung.catalog import sql
from logrung.catalog.base import masked_logs, parsed_logs, query
from logrung.functions import severity as sev
from logrung.functions.levels import canonical_level, level_id, level_name, levels_table
from logrung.functions.masking import MASK_RULES, mask_rule, with_masked
from logrung.functions.parsing import (
    METADATA_FIELDS,
    parse_loose,
    parse_strict,
    strip_leaked_level,
)
from logrung.functions.text import dataset_key, first_tokens, placeholders, single_line, strip
from logrung.functions.vectors import argmax, gce_loss, label_probability, mean_pool, softmax, wce_loss
from logrung.plans.clustering import filter_level
from logrung.plans.train import training_rows
from logrung.sources.records import project_json


def _hit(pattern: str, line: str = "line") -> str:
    return (
        f"{sql.hit(line, pattern)} AS matched, {sql.group(line, pattern, 1)} AS line_timestamp, "
        f"{sql.group(line, pattern, 2)} AS line_level, {sql.trimmed(sql.group(line, pattern, 3))} AS message"
    )


def _flat(df, struct):
    return df.select(
        "event_id",
        F.col(struct).isNotNull().alias("matched"),
        *[F.coalesce(f"{struct}.{c}", F.lit("")).alias(c) for c in ("line_timestamp", "line_level", "message")],
    )


@query("parse_strict", f"{sql.WITH_LOGV} SELECT event_id, {_hit(sql.STRICT)} FROM logv")
def _(spark, sf):
    return _flat(parse_strict(fixtures.logv(spark, sf), "line", "p"), "p")


@query("parse_loose", f"{sql.WITH_LOGV} SELECT event_id, {_hit(sql.LOOSE)} FROM logv")
def _(spark, sf):
    return _flat(parse_loose(fixtures.logv(spark, sf), "line", "p"), "p")


@query(
    "parse_level_fallback",
    f"{sql.WITH_PARSED} SELECT event_id, line_level FROM parsed "
    f"WHERE NOT {sql.hit('raw_line', sql.STRICT)} AND NOT {sql.hit('raw_line', sql.LOOSE)}",
)
def _(spark, sf):
    rows = parse_loose(parse_strict(parsed_logs(spark, sf), "raw_line", "s"), "raw_line", "l")
    return rows.filter("s IS NULL AND l IS NULL").select("event_id", "line_level")


@query(
    "parse_leak_strip",
    f"{sql.WITH_LOGV} SELECT event_id, {sql.leak_strip(sql.trimmed('line'), 'upper(detected_level)')} AS message "
    "FROM logv WHERE detected_level <> ''",
)
def _(spark, sf):
    rows = fixtures.logv(spark, sf).filter("detected_level <> ''")
    return rows.select(
        "event_id",
        strip_leaked_level(strip(F.col("line")), F.upper("detected_level")).alias("message"),
    )


@query(
    "parse_full",
    f"{sql.WITH_PARSED} SELECT event_id, raw_line, line_timestamp, line_level, message FROM parsed",
)
def _(spark, sf):
    return parsed_logs(spark, sf).select("event_id", "raw_line", "line_timestamp", "line_level", "message")


# Records as JSON text, built from events: some without fields, some with null
# fields, some with a known level, all with one key the parser must ignore.
_RECORD = """
 concat('{{"timestamp":"', CAST(event_id AS {S}), '","line":"', event_type, ' ', CAST(user_id AS {S}), '"',
   CASE CAST(event_id % 4 AS INT) WHEN 0 THEN ''
     WHEN 1 THEN ',"fields":null'
     WHEN 2 THEN concat(',"fields":{{"app":"', event_type, '","pod":"p', CAST(user_id % 7 AS {S}), '","extra":', props, '}}')
     ELSE concat(',"fields":{{"detected_level":"', event_type, '","job":null}}') END,
   CASE WHEN event_id % 5 = 0 THEN ',"unused":[1,2]' ELSE '' END, '}}')
"""


def _records(spark, sf):
    return fixtures.table(spark, sf, "events").select("event_id", F.expr(_RECORD.format(S="STRING")).alias("record"))


_RECORDS_SQL = f"SELECT event_id, {_RECORD.format(S='VARCHAR')} AS record FROM events"


@query(
    "json_fields",
    "SELECT event_id, coalesce(json_extract_string(record, '$.line'), '') AS raw_line, "
    "coalesce(json_extract_string(record, '$.timestamp'), '') AS log_timestamp, "
    "coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k "
    f"FROM (SELECT r.*, e.props FROM ({_RECORDS_SQL}) r JOIN events e USING (event_id))",
)
def _(spark, sf):
    props = fixtures.table(spark, sf, "events").select(
        "event_id",
        F.coalesce(F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint"), F.lit(-1)).alias("k"),
        F.expr(_RECORD.format(S="STRING")).alias("record"),
    )
    return project_json(props, "record").select("event_id", "raw_line", "log_timestamp", "k")


@query(
    "metadata_project",
    "SELECT event_id, "
    + ", ".join(f"coalesce(json_extract_string(record, '$.fields.{n}'), '') AS {n}" for n in METADATA_FIELDS)
    + f" FROM ({_RECORDS_SQL})",
)
def _(spark, sf):
    return project_json(_records(spark, sf), "record").select("event_id", "metadata.*")


@query(
    "filter_level",
    f"{sql.WITH_PARSED} SELECT event_id, message, upper(line_level) AS level FROM parsed "
    "WHERE message <> '' AND upper(line_level) <> 'UNKNOWN'",
)
def _(spark, sf):
    return filter_level(parsed_logs(spark, sf), include_unknown=False).select("event_id", "message", "level")


@query(
    "filter_one_level",
    f"{sql.WITH_PARSED} SELECT event_id, message, upper(line_level) AS level FROM parsed "
    "WHERE message <> '' AND upper(line_level) = 'WARN'",
)
def _(spark, sf):
    return filter_level(parsed_logs(spark, sf), level="warn").select("event_id", "message", "level")


@query(
    "training_rows",
    f"{sql.WITH_MASKED} SELECT event_id, masked AS text, {sql.class_id('line_level')} AS label FROM masked "
    f"WHERE {sql.class_id('line_level')} IS NOT NULL",
)
def _(spark, sf):
    return training_rows(parsed_logs(spark, sf), ["event_id"])


def _mask_query(name: str) -> None:
    @query(f"mask_{name}", f"{sql.WITH_LOGV} SELECT event_id, {sql.rule_sql('line', name)} AS masked FROM logv")
    def _(spark, sf):
        return fixtures.logv(spark, sf).select("event_id", mask_rule(F.col("line"), name).alias("masked"))


for _rule in MASK_RULES:
    _mask_query(_rule.name)


@query("mask_full", f"{sql.WITH_LOGV} SELECT event_id, {sql.mask_sql('line')} AS masked FROM logv")
def _(spark, sf):
    return with_masked(fixtures.logv(spark, sf), "line", "masked").select("event_id", "masked")


@query("mask_batch", f"{sql.WITH_MASKED} SELECT event_id, masked FROM masked WHERE message <> ''")
def _(spark, sf):
    return masked_logs(spark, sf).filter("message <> ''").select("event_id", "masked")


@query(
    "canonical_level",
    f"{sql.WITH_PARSED} SELECT event_id, {sql.canonical('line_level')} AS level FROM parsed",
)
def _(spark, sf):
    return parsed_logs(spark, sf).select("event_id", canonical_level(F.col("line_level")).alias("level"))


@query("level_id", f"{sql.WITH_PARSED} SELECT event_id, {sql.class_id('line_level')} AS label FROM parsed")
def _(spark, sf):
    return parsed_logs(spark, sf).select("event_id", level_id(F.col("line_level")).alias("label"))


@query(
    "id_level",
    "SELECT event_id, CASE CAST(user_id % 8 AS INT) WHEN 0 THEN 'TRACE' WHEN 1 THEN 'DEBUG' WHEN 2 THEN 'INFO' "
    "WHEN 3 THEN 'WARN' WHEN 4 THEN 'ERROR' WHEN 5 THEN 'FATAL' END AS level FROM events",
)
def _(spark, sf):
    ids = fixtures.table(spark, sf, "events")
    return ids.select("event_id", level_name(F.col("user_id") % 8).alias("level"))


@query(
    "join_levels",
    f"{sql.WITH_SCOREV} SELECT event_id, observed, {sql.class_id('observed')} AS id, "
    f"CASE WHEN {sql.class_id('observed')} IS NULL THEN NULL ELSE {sql.canonical('observed')} END AS canonical FROM scorev",
)
def _(spark, sf):
    rows = fixtures.scorev(spark, sf).withColumn("name", F.upper("observed"))
    # 31 fixed names.
    return rows.join(F.broadcast(levels_table(spark)), "name", "left").select(
        "event_id", "observed", "id", "canonical"
    )


@query("sev_normalize", f"{sql.WITH_SCOREV} SELECT event_id, {sql.sev_name('observed')} AS severity FROM scorev")
def _(spark, sf):
    return fixtures.scorev(spark, sf).select(
        "event_id", sev.normalize_severity(F.col("observed")).alias("severity")
    )


@query("sev_rank", f"{sql.WITH_SCOREV} SELECT event_id, {sql.sev_rank('observed')} AS rank FROM scorev")
def _(spark, sf):
    return fixtures.scorev(spark, sf).select("event_id", sev.severity_rank(F.col("observed")).alias("rank"))


@query(
    "sev_distance",
    f"{sql.WITH_SCOREV} SELECT event_id, abs({sql.sev_rank('observed')} - {sql.sev_rank('predicted')}) AS distance FROM scorev",
)
def _(spark, sf):
    return fixtures.scorev(spark, sf).select(
        "event_id", sev.severity_distance(F.col("observed"), F.col("predicted")).alias("distance")
    )


@query(
    "sev_direction",
    f"{sql.WITH_SCOREV} SELECT event_id, mismatch_direction FROM ({sql.mismatch('scorev', 'observed', 'predicted')})",
)
def _(spark, sf):
    return fixtures.scorev(spark, sf).select(
        "event_id",
        sev.mismatch_direction(F.col("observed"), F.col("predicted")).alias("mismatch_direction"),
    )


@query("sev_critical", f"{sql.WITH_SCOREV} SELECT event_id, {sql.sev_rank('observed')} >= 4 AS critical FROM scorev")
def _(spark, sf):
    return fixtures.scorev(spark, sf).select("event_id", sev.is_critical(F.col("observed")).alias("critical"))


@query(
    "critical_miss",
    f"{sql.WITH_SCOREV} SELECT event_id, ({sql.sev_rank('observed')} >= 4 AND "
    f"{sql.sev_rank('predicted')} < {sql.sev_rank('observed')}) AS miss FROM scorev",
)
def _(spark, sf):
    return fixtures.scorev(spark, sf).select(
        "event_id", sev.is_critical_miss(F.col("observed"), F.col("predicted")).alias("miss")
    )


_MISMATCH = (
    "event_id, observed_severity, predicted_severity, severity_distance, mismatch_direction, confidence, "
    "risk_weight, anomaly_score, anomaly_threshold, is_anomaly"
)


@query(
    "mismatch_score",
    f"{sql.WITH_SCOREV} SELECT {_MISMATCH} FROM ({sql.mismatch('scorev', 'observed', 'predicted')})",
)
def _(spark, sf):
    return sev.score_mismatch(fixtures.scorev(spark, sf)).select(*_MISMATCH.split(", "))


@query(
    "apply_threshold",
    f"{sql.WITH_SCOREV} SELECT event_id, anomaly_threshold, is_anomaly FROM "
    f"({sql.mismatch('scorev', 'observed', 'predicted', '35e0')})",
)
def _(spark, sf):
    scored = sev.score_mismatch(fixtures.scorev(spark, sf))
    return sev.apply_threshold(scored, F.lit(35.0)).select("event_id", "anomaly_threshold", "is_anomaly")


_LOGITS_SQL = "SELECT vec_id, label, list_transform(embedding[1:6], lambda x: CAST(x AS DOUBLE)) AS z FROM embeddings"


def _logits(spark, sf):
    return fixtures.emb(spark, sf).withColumn("z", F.slice("embedding", 1, 6))


@query(
    "softmax_argmax",
    f"""SELECT vec_id, list_extract(['TRACE','DEBUG','INFO','WARN','ERROR','FATAL'], list_position(z, list_max(z))) AS predicted,
        round(100 / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))), 6) AS confidence FROM ({_LOGITS_SQL})""",
)
def _(spark, sf):
    p = _logits(spark, sf).withColumn("p", softmax(F.col("z")))
    return p.select(
        "vec_id",
        level_name(argmax(F.col("p")), "UNKNOWN").alias("predicted"),
        F.round(F.array_max("p") * 100, 6).alias("confidence"),
    )


_P_SQL = f"""SELECT vec_id, target, exp(z[target + 1]) / list_sum(list_transform(z, lambda x: exp(x))) AS p
  FROM (SELECT *, CAST(label % 6 AS INTEGER) AS target FROM ({_LOGITS_SQL}))"""


def _targets(spark, sf):
    rows = _logits(spark, sf).withColumn("target", (F.col("label") % 6).cast("int"))
    return rows.withColumn("p", label_probability(softmax(F.col("z")), F.col("target")))


@query("gce_loss", f"SELECT vec_id, round((1 - pow(greatest(p, 1e-8), 0.7e0)) / 0.7e0, 6) AS loss FROM ({_P_SQL})")
def _(spark, sf):
    return _targets(spark, sf).select("vec_id", F.round(gce_loss(F.col("p")), 6).alias("loss"))


@query("wce_loss", f"SELECT vec_id, round(-(target + 1) / 2e0 * ln(p), 6) AS loss FROM ({_P_SQL})")
def _(spark, sf):
    weight = (F.col("target") + 1) / F.lit(2.0)
    return _targets(spark, sf).select("vec_id", F.round(wce_loss(F.col("p"), weight), 6).alias("loss"))


# Each vector is read as eight tokens of width eight; about a third is padding.
@query(
    "mean_pool",
    """SELECT vec_id, CAST(d AS INTEGER) AS dim,
        round(sum(CAST(embedding[t * 8 + d + 1] AS DOUBLE) * m) / greatest(sum(m), 1e-9), 6) AS pooled
       FROM (SELECT vec_id, embedding, t, CASE WHEN (vec_id + t) % 3 < 2 THEN 1e0 ELSE 0e0 END AS m
             FROM embeddings, range(8) tt(t)), range(8) dd(d) GROUP BY vec_id, d""",
)
def _(spark, sf):
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("embedding", t * 8 + 1, 8))
    mask = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda t: F.when((F.col("vec_id") + t) % 3 < 2, 1.0).otherwise(0.0),
    )
    pooled = fixtures.emb(spark, sf).select("vec_id", mean_pool(tokens, mask, 8).alias("v"))
    return pooled.select("vec_id", F.posexplode("v").alias("dim", "x")).select(
        "vec_id", "dim", F.round("x", 6).alias("pooled")
    )


@query(
    "placeholders",
    f"{sql.WITH_MASKED} SELECT event_id, array_to_string(regexp_extract_all(masked, '<[^<>\\s]+>'), ' ') AS tokens FROM masked",
)
def _(spark, sf):
    return masked_logs(spark, sf).select(
        "event_id", F.array_join(placeholders(F.col("masked")), " ").alias("tokens")
    )


@query(
    "dataset_key",
    """SELECT event_id, CASE WHEN user_id % 3 = 0 THEN concat(event_type, '.v1') ELSE concat('ds', CAST(user_id % 4 AS VARCHAR)) END AS dataset
       FROM events""",
)
def _(spark, sf):
    path = F.expr(
        """CASE CAST(user_id % 3 AS INT) WHEN 0 THEN concat('file:///srv/corpus/', event_type, '.v1.log')
           WHEN 1 THEN concat('file:///srv/corpus/ds', user_id % 4, '/', event_type, '.log')
           ELSE concat('file:///srv/corpus/ds', user_id % 4, '/deep/er/', event_type, '.json') END"""
    )
    return fixtures.table(spark, sf, "events").select("event_id", dataset_key(path, "/srv/corpus/").alias("dataset"))


@query(
    "newline_collapse",
    f"{sql.WITH_LOGV} SELECT event_id, rtrim(replace(replace(line, concat(chr(13), chr(10)), ' '), chr(10), ' '), {sql.SPACE}) AS line FROM logv",
)
def _(spark, sf):
    return fixtures.logv(spark, sf).select("event_id", single_line(F.col("line")).alias("line"))


# White space as a class both engines read alike.
_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(
    "truncate_tokens",
    f"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '{_BLANK}'), lambda x: x <> '')[1:512], ' ') AS text FROM documents",
)
def _(spark, sf):
    return fixtures.table(spark, sf, "documents").select("doc_id", first_tokens(F.col("text"), 512).alias("text"))

"""Queries on placeholder tokens and templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from logrung import fixtures
from logrung.catalog import sql
from logrung.catalog.base import landed, masked_logs, parsed_logs, query, staged_logs
from logrung.operators import templates as tp
from logrung.operators import tokens as tk
from logrung.plans.templating import match_rows, mine_rows, template_job
from logrung.sources.files import scan_parsed

_TOKENS = f"""{sql.WITH_MASKED}, tokens AS (SELECT detected_level, unnest(regexp_extract_all(masked, '<[^<>\\s]+>')) AS token FROM masked)"""


@query("token_vocabulary", f"{_TOKENS} SELECT DISTINCT token FROM tokens ORDER BY token")
def _(spark, sf):
    return tk.token_vocabulary(masked_logs(spark, sf), "masked")


@query(
    "new_tokens",
    f"{_TOKENS} SELECT DISTINCT token FROM tokens WHERE token NOT IN (SELECT token FROM tokens WHERE detected_level <> '')",
)
def _(spark, sf):
    rows = masked_logs(spark, sf)
    vocabulary = tk.token_vocabulary(rows.filter("detected_level <> ''"), "masked")
    return tk.new_tokens(tk.token_vocabulary(rows, "masked"), vocabulary)


@query(
    "tokenize",
    r"""SELECT doc_id, len(w) AS n_words, array_to_string(w, ' ') AS words FROM (
        SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM documents)""",
)
def _(spark, sf):
    words = tk.tokenize(fixtures.table(spark, sf, "documents").select("doc_id", "text"))
    return words.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.array_join("words", " ").alias("words")
    )


# A frozen template table; some messages match two templates, some none.
_TEMPLATES = [
    (1, "<CLASS_NAME> - <*> took <NUM> ms"),
    (2, "<*> from <IP> id <NUM>"),
    (3, "<*> <COMPOSITE_ID>"),
    (4, "signup <COMPOSITE_ID>"),
    (5, "<*> corrected <NUM>"),
    (6, "purchase <*> <NUM>"),
    (7, "<*> completed for user <NUM> hex <*>"),
    (8, 'upstream host: "<HOST>" <PID>: <CONN_ID> uuid <UUID>'),
    (9, "<*> <NUM>"),
    (10, "<NUM>"),
]
_TEMPLATE_VALUES = ", ".join(f"({i}, {sql.quoted(t)})" for i, t in _TEMPLATES)
_MATCHED = f"""{sql.WITH_MASKED}, known AS (SELECT id, t, string_split(t, ' ') AS tw FROM (VALUES {_TEMPLATE_VALUES}) v(id, t)),
 texts AS (SELECT event_id, message, masked, list_filter(regexp_split_to_array(masked, '\\s+'), lambda x: x <> '') AS w FROM masked),
 hits AS (SELECT event_id, id, t, row_number() OVER (PARTITION BY event_id ORDER BY len(list_filter(tw, lambda x: x = '<*>')), id) AS place
   FROM texts JOIN known ON len(w) = len(tw)
   WHERE len(list_filter(range(len(w)), lambda i: tw[i + 1] <> '<*>' AND tw[i + 1] <> w[i + 1])) = 0),
 matched AS (SELECT x.event_id, masked, h.t IS NOT NULL AS matched, coalesce(h.t, '<UNKNOWN_FORMAT>') AS template
   FROM texts x LEFT JOIN hits h ON x.event_id = h.event_id AND h.place = 1)"""


def _matched(spark, sf):
    known = spark.createDataFrame(_TEMPLATES, "template_id long, template string")
    rows = masked_logs(spark, sf).select("event_id", "masked")
    return tp.match_templates(landed(rows, "masked"), known)


@query("template_match", f"{_MATCHED} SELECT event_id, template, matched, masked FROM matched")
def _(spark, sf):
    return _matched(spark, sf).select("event_id", "template", "matched", "masked")


@query(
    "ml_input_text",
    f"{_MATCHED} SELECT event_id, CASE WHEN matched THEN template ELSE masked END AS text FROM matched",
)
def _(spark, sf):
    rows = _matched(spark, sf)
    text = tp.ml_input_text(F.col("template"), F.col("matched"), F.col("masked"))
    return rows.select("event_id", text.alias("text"))


@query(
    "template_coverage",
    f"{_MATCHED} SELECT count_if(matched) AS matched, count_if(NOT matched) AS unmatched FROM matched WHERE masked <> ''",
)
def _(spark, sf):
    return tp.template_coverage(_matched(spark, sf))


_EQUAL = "len(list_filter(range(1, len({w}) + 1), lambda i: {k}[i] = {w}[i] AND {k}[i] <> '<*>'))"


def _mined(p: str, source: str, stored: str) -> str:
    """CTEs that mine the texts of ``source`` on from ``stored`` (text, rows): ``{p}mined``.

    Leaders by a fold over the messages of each leaf, members by most equal
    tokens, fixed places by a fold over the sets of places that members share.
    Only for tables whose members all keep enough of their leader's places.
    """
    equal = _EQUAL.format(k="k", w="l.w")
    nearest = _EQUAL.format(k="leader", w="w")
    return f"""
{p}texts AS (SELECT text, count(*) AS rows FROM ({source}) GROUP BY text),
{p}stored AS (SELECT text, sum(rows) AS rows FROM ({stored}) GROUP BY text),
{p}fits AS (SELECT x.text, x.rows, s.text AS template, string_split(x.text, ' ') AS xw, string_split(s.text, ' ') AS sw
   FROM {p}texts x, {p}stored s),
{p}taken AS (SELECT text, rows, template FROM {p}fits WHERE len(xw) = len(sw)
   AND len(list_filter(range(1, len(xw) + 1), lambda i: sw[i] <> '<*>' AND sw[i] <> xw[i])) = 0
   QUALIFY row_number() OVER (PARTITION BY text ORDER BY len(list_filter(sw, lambda t: t = '<*>'))) = 1),
{p}weighed AS (SELECT *, string_split(text, ' ') AS w, len(string_split(text, ' ')) AS width,
   CASE WHEN regexp_matches(string_split(text, ' ')[1], '[0-9]') THEN '<*>' ELSE string_split(text, ' ')[1] END AS token
   FROM (SELECT text, rows, false AS old FROM {p}texts UNION ALL SELECT text, rows, true AS old FROM {p}stored)),
{p}branches AS (SELECT width, token, token AS branch FROM {p}weighed GROUP BY width, token
   QUALIFY row_number() OVER (PARTITION BY width ORDER BY sum(rows) DESC, token) < 100),
{p}placed AS (SELECT text, rows, old, w, width, width || ' ' || coalesce(branch, '<*>') AS leaf
   FROM {p}weighed LEFT JOIN {p}branches USING (width, token)
   WHERE old OR text NOT IN (SELECT text FROM {p}taken)),
{p}leafed AS (SELECT *, row_number() OVER (PARTITION BY leaf, old ORDER BY rows DESC, text) AS n FROM {p}placed),
{p}start AS (SELECT leaf, list(w ORDER BY n) FILTER (WHERE old) AS leaders FROM {p}leafed GROUP BY leaf HAVING count_if(NOT old) > 0),
{p}fold(leaf, n, leaders) AS (
  SELECT leaf, CAST(0 AS BIGINT), coalesce(leaders, CAST([] AS VARCHAR[][])) FROM {p}start
  UNION ALL SELECT f.leaf, l.n, CASE WHEN len(list_filter(f.leaders, lambda k: {equal} / l.width >= CAST(0.4 AS DOUBLE))) > 0
    THEN f.leaders ELSE list_append(f.leaders, l.w) END
  FROM {p}fold f JOIN {p}leafed l ON l.leaf = f.leaf AND NOT l.old AND l.n = f.n + 1),
{p}leaders AS (SELECT leaf, unnest(leaders) AS leader, unnest(range(len(leaders))) AS place
   FROM (SELECT leaf, arg_max(leaders, n) AS leaders FROM {p}fold GROUP BY leaf)),
{p}led AS (SELECT *, list_transform(range(1, width + 1), lambda i: CASE WHEN leader[i] = w[i] AND w[i] <> '<*>' THEN 1 ELSE 0 END) AS mask
   FROM (SELECT text, rows, l.leaf, w, width, leader, place, {nearest} AS equal FROM {p}leafed l JOIN {p}leaders USING (leaf) WHERE NOT old)
   WHERE equal / width >= CAST(0.4 AS DOUBLE)
   QUALIFY row_number() OVER (PARTITION BY text ORDER BY equal DESC, place) = 1),
{p}masks AS (SELECT leaf, leader, mask, count(*) AS messages, sum(rows) AS rows,
   row_number() OVER (PARTITION BY leaf, leader ORDER BY sum(rows) DESC, mask DESC) AS n FROM {p}led GROUP BY leaf, leader, mask),
{p}shape(leaf, leader, n, fixed) AS (
  SELECT leaf, leader, CAST(0 AS BIGINT), list_transform(leader, lambda t: CASE WHEN t = '<*>' THEN 0 ELSE 1 END)
  FROM {p}masks WHERE n = 1
  UNION ALL SELECT s.leaf, s.leader, m.n, list_transform(range(1, len(s.fixed) + 1), lambda i: s.fixed[i] * m.mask[i])
  FROM {p}shape s JOIN {p}masks m ON m.leaf = s.leaf AND m.leader = s.leader AND m.n = s.n + 1),
{p}grown AS (SELECT s.leaf, array_to_string(s.leader, ' ') AS was, k.messages, k.rows,
   array_to_string(list_transform(range(1, len(fixed) + 1), lambda i: CASE WHEN fixed[i] = 1 THEN s.leader[i] ELSE '<*>' END), ' ') AS template
   FROM {p}shape s JOIN (SELECT leaf, leader, max(n) AS n, sum(messages) AS messages, sum(rows) AS rows FROM {p}masks GROUP BY leaf, leader) k
   ON s.leaf = k.leaf AND s.leader = k.leader AND s.n = k.n),
{p}old AS (SELECT coalesce(g.template, o.was) AS template, o.messages, o.rows FROM (
    SELECT text AS was, 0 AS messages, rows FROM {p}stored
    UNION ALL SELECT template, count(*), sum(rows) FROM {p}taken GROUP BY template) o
   LEFT JOIN {p}grown g ON g.was = o.was),
{p}mined AS (SELECT template, CAST(len(string_split(template, ' ')) AS INTEGER) AS n_tokens,
    CAST(sum(messages) AS BIGINT) AS messages, CAST(sum(rows) AS BIGINT) AS rows, min(is_new) AS is_new
  FROM (SELECT template, messages, rows, was NOT IN (SELECT text FROM {p}stored) AS is_new FROM {p}grown
        UNION ALL SELECT template, messages, rows, false AS is_new FROM {p}old) GROUP BY template)"""



# Masked messages with single blanks; ``{p}`` tells uses apart.
_TEXTS = r"SELECT array_to_string(list_filter(regexp_split_to_array(masked, '\s+'), lambda x: x <> ''), ' ') AS text FROM masked WHERE trim(masked) <> ''"
_NONE_STORED = "SELECT CAST(NULL AS VARCHAR) AS text, CAST(0 AS BIGINT) AS rows WHERE false"
_RECURSIVE = sql.WITH_MASKED.replace("WITH ", "WITH RECURSIVE ", 1)
_RESULT = ("template", "n_tokens", "messages", "rows", "is_new")


@query(
    "mine_templates",
    f"{_RECURSIVE}, {_mined('m_', _TEXTS, _NONE_STORED)} SELECT template, n_tokens, messages, rows, is_new FROM m_mined",
)
def _(spark, sf):
    return mine_rows(parsed_logs(spark, sf)).select(*_RESULT)


@query(
    "template_totals",
    f"{_RECURSIVE}, {_mined('m_', _TEXTS, _NONE_STORED)} SELECT CAST(sum(rows) AS BIGINT) AS messages, count(*) AS templates FROM m_mined",
)
def _(spark, sf):
    return tp.template_totals(landed(mine_rows(parsed_logs(spark, sf)), "templates"))


_FIRST = "dataset IN ('ds0', 'ds1')"


@query(
    "mine_templates_incremental",
    f"{_RECURSIVE}, {_mined('a_', f'{_TEXTS} AND {_FIRST}', _NONE_STORED)},"
    f" {_mined('b_', f'{_TEXTS} AND NOT {_FIRST}', 'SELECT template AS text, rows FROM a_mined')}"
    " SELECT template, n_tokens, messages, rows, is_new FROM b_mined",
)
def _(spark, sf):
    rows = parsed_logs(spark, sf)
    first = landed(mine_rows(rows.filter(_FIRST)), "templates")
    return mine_rows(rows.filter(f"NOT {_FIRST}"), first).select(*_RESULT)


# Saved templates: one takes messages as it stands, one grows more general, one takes nothing.
_SAVED = [
    ("<*> from <IP> id <NUM>", 40),
    ("purchase completed for user root hex none", 7),
    ("nothing looks like this", 3),
    ("<*> <COMPOSITE_ID>", 11),
]
_SAVED_VALUES = f"SELECT * FROM (VALUES {', '.join(f'({sql.quoted(t)}, CAST({n} AS BIGINT))' for t, n in _SAVED)}) v(text, rows)"


@query(
    "continue_templates",
    f"{_RECURSIVE}, {_mined('c_', _TEXTS, _SAVED_VALUES)} SELECT template, n_tokens, messages, rows, is_new FROM c_mined",
)
def _(spark, sf):
    saved = spark.createDataFrame(_SAVED, "template string, rows long")
    return mine_rows(parsed_logs(spark, sf), saved).select(*_RESULT)


# Every mined message must be covered by the templates mined from it.
@query(
    "mined_coverage",
    f"{sql.WITH_MASKED} SELECT count(*) AS matched, CAST(0 AS BIGINT) AS unmatched FROM masked WHERE masked <> ''",
)
def _(spark, sf):
    rows = parsed_logs(spark, sf)
    templates = landed(mine_rows(rows), "templates")
    return tp.template_coverage(match_rows(rows, templates))


@query("template_job")
def _(spark, sf):
    parsed = landed(scan_parsed(spark, staged_logs(spark, sf)), "parsed")
    train, test = parsed.filter("dataset IN ('ds0', 'ds1')"), parsed.filter("dataset NOT IN ('ds0', 'ds1')")
    _, totals, coverage = template_job(train, test)
    flat = totals.withColumn("part", F.lit("train")).selectExpr(
        "part", "stack(2, 'messages', messages, 'templates', templates) AS (metric, value)"
    )
    tested = coverage.withColumn("part", F.lit("test")).selectExpr(
        "part", "stack(2, 'matched', matched, 'unmatched', unmatched) AS (metric, value)"
    )
    return flat.unionByName(tested)

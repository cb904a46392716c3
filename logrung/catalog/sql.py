"""Building blocks of the SQL checks (DuckDB dialect, RE2 patterns)."""

from __future__ import annotations

from logrung.fixtures import LOGV_SQL, SCOREV_SQL
from logrung.functions.levels import CANONICAL_OF, ID_OF
from logrung.functions.masking import MASK_RULES
from logrung.functions.parsing import LOOSE_LINE, STRICT_LINE
from logrung.functions.severity import DEFAULT_ALIASES, DEFAULT_ORDER

SPACE = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trimmed(x: str) -> str:
    return f"trim({x}, {SPACE})"


def group(x: str, pattern: str, n: int) -> str:
    return f"regexp_extract({x}, {quoted(pattern)}, {n})"


def hit(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {quoted(pattern)})"


STRICT = "(?i)" + STRICT_LINE
LOOSE = LOOSE_LINE

LEAK = (
    r"regexp_replace(MESSAGE, concat('(?i)^.*?\[?', LEVEL, '\]?\s*(?:-|:|\])?\s*'), '')"
)


def leak_strip(message: str, level: str) -> str:
    return trimmed(LEAK.replace("MESSAGE", message).replace("LEVEL", level))


# The parse: strict, then loose, then metadata, then UNKNOWN.
PARSED = f"""
parsed AS (
 SELECT event_id, dataset, raw_line, detected_level,
  CASE WHEN s THEN {group('raw_line', STRICT, 1)} WHEN l THEN {group('raw_line', LOOSE, 1)} ELSE '' END AS line_timestamp,
  lvl AS line_level,
  CASE WHEN s THEN {trimmed(group('raw_line', STRICT, 3))}
       WHEN l THEN {trimmed(group('raw_line', LOOSE, 3))}
       WHEN lvl <> 'UNKNOWN' THEN {leak_strip(trimmed('raw_line'), 'lvl')}
       ELSE {trimmed('raw_line')} END AS message
 FROM (SELECT *, CASE WHEN s THEN {group('raw_line', STRICT, 2)} WHEN l THEN {group('raw_line', LOOSE, 2)}
                      WHEN detected_level <> '' THEN upper(detected_level) ELSE 'UNKNOWN' END AS lvl
       FROM (SELECT event_id, dataset, line AS raw_line, detected_level,
                    {hit('line', STRICT)} AS s, NOT {hit('line', STRICT)} AND {hit('line', LOOSE)} AS l FROM logv)))
"""

LOGV = f"logv AS ({LOGV_SQL})"
SCOREV = f"scorev AS ({SCOREV_SQL})"


# The plain form of the two rules that the package writes for linear time.
PLAIN_RULES = {
    "class": r"\b(?:[a-zA-Z0-9_]+\.)+[A-Z][a-zA-Z0-9_]+\b",
    "composite": r"\b\d+(?:_\d+)+\b",
}


def rule_sql(x: str, name: str) -> str:
    rule = next(r for r in MASK_RULES if r.name == name)
    pattern = PLAIN_RULES.get(name, rule.pattern)
    replacement = rule.replacement.replace("$", "\\")
    return f"regexp_replace({x}, {quoted(pattern)}, {quoted(replacement)}, 'g')"


def mask_sql(x: str) -> str:
    for rule in MASK_RULES:
        x = rule_sql(x, rule.name)
    return x


MASKED = f"masked AS (SELECT *, {mask_sql('message')} AS masked FROM parsed)"


def in_list(names) -> str:
    return ", ".join(quoted(n) for n in names)


def canonical(x: str) -> str:
    """Canonical level name, other labels upper-cased."""
    up = trimmed(f"upper({x})")
    by_level: dict[str, list[str]] = {}
    for name, level in CANONICAL_OF.items():
        by_level.setdefault(level, []).append(name)
    whens = " ".join(f"WHEN {up} IN ({in_list(ns)}) THEN {quoted(lv)}" for lv, ns in by_level.items())
    return f"(CASE {whens} ELSE {up} END)"


def class_id(x: str) -> str:
    by_id: dict[int, list[str]] = {}
    for name, i in ID_OF.items():
        by_id.setdefault(i, []).append(name)
    whens = " ".join(f"WHEN upper({x}) IN ({in_list(ns)}) THEN {i}" for i, ns in by_id.items())
    return f"CAST(CASE {whens} END AS INTEGER)"


def sev_name(x: str) -> str:
    up = trimmed(f"upper({x})")
    aliases = " ".join(f"WHEN {quoted(a)} THEN {quoted(t)}" for a, t in DEFAULT_ALIASES.items())
    return f"(CASE {up} {aliases} ELSE (CASE WHEN {up} IN ({in_list(DEFAULT_ORDER)}) THEN {up} ELSE 'INFO' END) END)"


def sev_rank(x: str) -> str:
    whens = " ".join(f"WHEN {quoted(n)} THEN {i}" for i, n in enumerate(DEFAULT_ORDER))
    return f"CAST(CASE {sev_name(x)} {whens} END AS INTEGER)"


def mismatch(source: str, observed: str, predicted: str, threshold: str = "2e1") -> str:
    """A SELECT that appends the mismatch columns to ``source``."""
    return f"""
 SELECT * EXCLUDE (o, p), CAST({threshold} AS DOUBLE) AS anomaly_threshold,
        (severity_distance > 0 AND anomaly_score >= {threshold}) AS is_anomaly
 FROM (SELECT *, (severity_distance / 5e0) * confidence * risk_weight AS anomaly_score
  FROM (SELECT *, abs(o - p) AS severity_distance,
         CASE WHEN p < o THEN 'under_prediction' WHEN p > o THEN 'over_prediction' ELSE 'match' END AS mismatch_direction,
         CASE WHEN p < o THEN 1.5e0 ELSE 1e0 END AS risk_weight
   FROM (SELECT *, {sev_name(observed)} AS observed_severity, {sev_name(predicted)} AS predicted_severity,
          {sev_rank(observed)} AS o, {sev_rank(predicted)} AS p FROM {source})))
"""


BASE = f"base AS (SELECT event_id, {canonical('observed')} AS true_label, predicted AS predicted_label, confidence FROM scorev)"
SCORED = f"scored AS ({mismatch('base', 'true_label', 'predicted_label')})"
MISS = f"(CASE WHEN {sev_rank('true_label')} >= 4 AND {sev_rank('predicted_label')} < {sev_rank('true_label')} THEN 1 ELSE 0 END)"

WITH_LOGV = f"WITH {LOGV}"
WITH_PARSED = f"WITH {LOGV}, {PARSED}"
WITH_MASKED = f"WITH {LOGV}, {PARSED}, {MASKED}"
WITH_SCOREV = f"WITH {SCOREV}"
WITH_SCORED = f"WITH {SCOREV}, {BASE}, {SCORED}"
WITH_SCORED_LOGS = f"""WITH {LOGV}, {PARSED}, {MASKED}, {SCOREV}, {BASE}, {SCORED},
scored_logs AS (SELECT s.*, m.dataset, m.raw_line, m.masked AS message, e.props AS raw_json
  FROM scored s JOIN masked m USING (event_id) JOIN events e USING (event_id))"""

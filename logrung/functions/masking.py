"""Masking rules: variable parts of a message become placeholders."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logrung.functions.text import computed_once, replace_pattern


@dataclass(frozen=True)
class MaskRule:
    """One rule. ``needs`` is a plain text without which nothing can match."""

    name: str
    pattern: str
    replacement: str
    needs: str | None = None
    #: (pattern, replacement) applied before the rule; what it inserts is taken out again.
    parts: tuple[str, str] | None = None


#: Parts a text where a dotted name cannot go on; no character of any text.
_PART = "\uffff"

# Patterns and placeholders, in the order they apply.
MASK_RULES = (
    MaskRule("ansi", r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])", "", "\x1b"),
    MaskRule("bracket", r"\[[^\]]+\]", "<MASKED_INFO>", "["),
    # The same names as \b(?:[a-zA-Z0-9_]+\.)+[A-Z][a-zA-Z0-9_]+\b, without a repeated
    # group: the engine would recurse once for each dot. A dotted run is tried from its
    # first name only, so a run that fails is read once. Runs are parted between two dots,
    # and behind a first name that no word boundary begins.
    MaskRule(
        "class",
        r"(?<![a-zA-Z0-9_]\.)\b[a-zA-Z0-9_][a-zA-Z0-9_.]*(?<=[a-zA-Z0-9_]\.)[A-Z][a-zA-Z0-9_]+\b",
        "<CLASS_NAME>",
        ".",
        (r"(\.)(?=\.)|(?<=[\w&&[^a-zA-Z0-9_]])([a-zA-Z0-9_]++\.)", f"$1$2{_PART}"),
    ),
    # Possessive, for the same reason; no shorter form of a run ends at a boundary.
    MaskRule("composite", r"\b\d++(?:_\d++)++\b", "<COMPOSITE_ID>", "_"),
    MaskRule("ip", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<IP>", "."),
    MaskRule(
        "uuid",
        r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
        "<UUID>",
        "-",
    ),
    MaskRule("hex", r"\b[0-9a-fA-F]{10,}\b", "<HEX>"),
    MaskRule("host", r'(host:\s*")[^"]+(")', "$1<HOST>$2", "host:"),
    MaskRule("pid", r"\b\d+#\d+:", "<PID>:", "#"),
    MaskRule("conn", r"\*\d+\b", "<CONN_ID>", "*"),
    MaskRule("num", r"\b\d+\b", "<NUM>"),
)
RULES_BY_NAME = {rule.name: rule for rule in MASK_RULES}


def mask_rule(col: Column, rule: str | MaskRule, prefix: str = "", suffix: str = "") -> Column:
    """Apply one rule. The plain-text check spares most rows the regex."""
    r = RULES_BY_NAME[rule] if isinstance(rule, str) else rule
    parted = replace_pattern(col, *r.parts) if r.parts else col
    masked = replace_pattern(parted, r.pattern, f"{prefix}{r.replacement}{suffix}")
    if r.parts:
        masked = F.replace(masked, F.lit(_PART), F.lit(""))
    return masked if r.needs is None else F.when(F.contains(col, F.lit(r.needs)), masked).otherwise(col)


def with_masked(
    df: DataFrame, source: str, target: str, prefix: str = "", suffix: str = ""
) -> DataFrame:
    """Append ``target``: all rules in order; null text becomes empty.

    Every rule is a projection of its own, so that each step is computed once
    although its check and its regex both read it.
    """
    step = F.col("_masked_step")
    out = df.withColumn("_masked_step", F.coalesce(F.col(source), F.lit("")))
    for rule in MASK_RULES:
        out = out.withColumn("_masked_step", mask_rule(step, rule, prefix, suffix))
    return computed_once(out, {target: step}).drop("_masked_step")

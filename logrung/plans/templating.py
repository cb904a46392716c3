"""Directory job for templates: mine on one corpus, match another."""

from __future__ import annotations

from pyspark.sql import DataFrame

from logrung.functions.masking import with_masked
from logrung.operators.templates import (
    match_templates,
    mine_templates,
    template_coverage,
    template_totals,
)
from logrung.session import landed


def mine_rows(parsed: DataFrame, stored: DataFrame | None = None, **settings) -> DataFrame:
    """Templates of the masked messages of parsed rows."""
    return mine_templates(with_masked(parsed, "message", "masked"), "masked", stored, **settings)


def match_rows(parsed: DataFrame, templates: DataFrame) -> DataFrame:
    """Parsed rows with masked, template_id, template and matched."""
    masked = landed(with_masked(parsed, "message", "masked"), "masked")
    return match_templates(masked, templates, "masked")


def template_job(
    train: DataFrame, test: DataFrame, stored: DataFrame | None = None, **settings
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(templates, training totals, coverage of the test rows)."""
    templates = landed(mine_rows(train, stored, **settings), "templates")
    return templates, template_totals(templates), template_coverage(match_rows(test, templates))

"""What ``__spark_entry__.py`` registers from this subpackage."""

from __future__ import annotations


def load_llm() -> tuple[dict, dict]:
    """(queries, checks) by name."""
    import corpus_pipeline
    from logrung.llm import queries  # noqa: F401
    from logrung.llm.registry import CHECKS, QUERIES

    checks = CHECKS | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
    return QUERIES | {"pipeline": corpus_pipeline.run}, checks

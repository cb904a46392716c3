"""Named queries over the test tables, each with its check in SQL."""


def load_catalog() -> tuple[dict, dict]:
    """(queries, checks) by name."""
    from logrung.catalog import jobs, lines, reports, samples, vectors, words  # noqa: F401
    from logrung.catalog.base import CHECKS, QUERIES

    return QUERIES, CHECKS

"""Text helpers shared by the parser, the masks and the exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Every character that counts as white space in a log line.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Line breaks besides \n, \r and \r\n.
EXTRA_LINE_BREAKS = "[\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def strip(col: Column) -> Column:
    """Drop white space of any kind from both ends."""
    return F.btrim(col, F.lit(WHITESPACE))


def rstrip(col: Column) -> Column:
    """Drop white space of any kind from the right end."""
    return F.rtrim(col, F.lit(WHITESPACE))


def replace_pattern(col: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    """``regexp_replace`` with Unicode classes and newline-only line ends."""
    return F.regexp_replace(col, f"(?dU{flags}){pattern}", replacement)


def is_blank(col: Column) -> Column:
    """True for empty and white-space-only text."""
    return strip(col) == ""


def single_line(col: Column) -> Column:
    """Turn inner newlines into blanks and trim the right end."""
    return rstrip(F.regexp_replace(col, "\r\n|\n", " "))


def first_tokens(col: Column, n: int) -> Column:
    """Keep the first ``n`` white-space-separated tokens, joined by one blank."""
    tokens = F.filter(F.split(col, r"(?U)[\s\x1c-\x1f]+"), lambda t: t != "")
    return F.array_join(F.slice(tokens, 1, n), " ")


def placeholders(col: Column, pattern: str = r"<[^<>\s]+>") -> Column:
    """All ``<...>`` tokens of a text, in order."""
    return F.regexp_extract_all(col, F.lit(f"(?U)({pattern})"), F.lit(1))


def dataset_key(path: Column, root: str) -> Column:
    """First path part below ``root``, or the file stem for a top-level file.

    ``path`` is a file URI or plain path; the text up to and including the
    first occurrence of ``root`` is dropped. A path that does not hold ``root``
    is an error; give the absolute form of relative roots.
    """
    prefix = "/" + root.split(":", 1)[-1].strip("/") + "/"
    start = F.instr(path, prefix) + F.lit(len(prefix))
    below = F.when(F.contains(path, F.lit(prefix)), F.substring(path, start, F.length(path))).otherwise(
        F.raise_error(F.concat(F.lit(f"not below {prefix}: "), path))
    )
    stem = F.regexp_replace(below, r"(?<=.)\.[^.]*$", "")
    return F.when(F.contains(below, F.lit("/")), F.substring_index(below, "/", 1)).otherwise(stem)


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Append columns as a one-element ``inline``.

    A filter on the result stays above it. With a plain projection the
    optimizer copies the expressions into the filter, so that costly ones
    run again and nested ones multiply.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))

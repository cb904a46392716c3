"""Level names, their aliases and class ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logrung.functions.text import strip

UNKNOWN = "UNKNOWN"

# The six classes in rising severity, and every accepted name.
CANONICAL_LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
LEVEL_NAMES = {
    "TRACE": ("TRACE", "T", "VERBOSE", "VERB", "V"),
    "DEBUG": ("DEBUG", "D", "DBG", "FINE", "FINER", "FINEST"),
    "INFO": ("INFO", "I", "NOTICE"),
    "WARN": ("WARN", "WARNING", "W", "WRN"),
    "ERROR": ("ERROR", "ERR", "E", "SEVERE"),
    "FATAL": (
        "FATAL", "F", "CRITICAL", "CRIT", "EMERG", "EMERGENCY", "ALERT", "PANIC", "DPANIC",
    ),
}

CLASS_ID = {level: i for i, level in enumerate(CANONICAL_LEVELS)}
CANONICAL_OF = {name: level for level, names in LEVEL_NAMES.items() for name in names}
ID_OF = {name: CLASS_ID[level] for name, level in CANONICAL_OF.items()}


def literal_map(mapping: dict) -> Column:
    """A constant map column (folded to a literal by the optimizer)."""
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def canonical_level(label: Column) -> Column:
    """Alias to canonical name; any other label passes through upper-cased."""
    name = strip(F.upper(label))
    return F.coalesce(F.try_element_at(literal_map(CANONICAL_OF), name), name)


def level_id(label: Column) -> Column:
    """Class id of an upper-cased level name or alias, null when unmapped."""
    return F.try_element_at(literal_map(ID_OF), F.upper(label))


def level_name(class_id: Column, fallback: str | None = None) -> Column:
    """Canonical name of a class id; ``fallback`` for ids outside the six."""
    names = literal_map({i: level for level, i in CLASS_ID.items()})
    found = F.try_element_at(names, class_id.cast("int"))
    return found if fallback is None else F.coalesce(found, F.lit(fallback))


def levels_table(spark: SparkSession) -> DataFrame:
    """The 31 names as a dimension table (name, id, canonical)."""
    rows = [(name, ID_OF[name], level) for name, level in CANONICAL_OF.items()]
    return spark.createDataFrame(rows, "name string, id int, canonical string")

from pyspark.sql import functions as F

from logrung.functions.levels import CANONICAL_LEVELS, ID_OF, canonical_level, level_id, level_name, levels_table


def test_canonical_names(spark):
    cases = {
        "I": "INFO", "warning": "WARN", "dbg": "DEBUG", "CRITICAL": "FATAL", " err ": "ERROR",
        "weird": "WEIRD", "unknown": "UNKNOWN",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "label string")
    got = {r.label: r.level for r in rows.select("label", canonical_level(F.col("label")).alias("level")).collect()}
    assert got == cases


def test_ids_and_names(spark):
    assert CANONICAL_LEVELS == ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
    assert len(ID_OF) == 31 and ID_OF["INFO"] == 2 and ID_OF["I"] == 2 and ID_OF["WARNING"] == 3
    rows = spark.range(7).select(level_name(F.col("id")).alias("n"), level_name(F.col("id"), "CLASS").alias("m"))
    assert [r.n for r in rows.collect()] == [*CANONICAL_LEVELS, None]
    assert rows.collect()[6].m == "CLASS"
    one = spark.createDataFrame([("severe",), ("nope",)], "x string").select(level_id(F.col("x")).alias("i"))
    assert [r.i for r in one.collect()] == [4, None]
    assert levels_table(spark).count() == 31

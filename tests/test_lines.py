"""Parser and mask on hand-written lines."""

from pyspark.sql import functions as F

from logrung.functions.masking import mask_rule, with_masked
from logrung.functions.parsing import parse_lines
from logrung.functions.text import dataset_key, placeholders, single_line


def parse(spark, *cases):
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, raw_line string, given string")
    out = parse_lines(rows, "raw_line", "given").orderBy("i").collect()
    return [(r.line_timestamp, r.line_level, r.message) for r in out]


def test_shapes(spark):
    got = parse(
        spark,
        ("2024-01-01 10:00:00,123 - root - WARNING - disk low", ""),
        ("2024-01-01T10:00:00.5Z INFO [main] started", ""),
        ("- 1117838570 2005.06.03 R02 RAS KERNEL INFO cache parity error", ""),
        ("I think it broke: badly", ""),
        ("NOTICE 2024-01-01 00:23:52 req] x", ""),
        ("plain text", ""),
        ("plain text", "error"),
        ("something [ERROR] - went wrong", "error"),
        ("prefix error -  went wrong", "error"),
        ("all fine here", "unknown"),
    )
    assert got[0] == ("2024-01-01 10:00:00,123 ", "WARNING", "disk low")
    assert got[1] == ("2024-01-01T10:00:00.5Z", "INFO", "started")
    assert got[2] == ("", "INFO", "cache parity error")
    assert got[3] == ("", "I", "badly")
    assert got[4] == ("", "NOTICE", "23:52 req] x")
    assert got[5] == ("", "UNKNOWN", "plain text")
    assert got[6] == ("", "ERROR", "plain text")
    assert got[7] == ("", "ERROR", "- went wrong")  # the bracket is a strict delimiter
    assert got[8] == ("", "error", "went wrong")
    assert got[9] == ("", "UNKNOWN", "all fine here")


def test_leaked_level_is_stripped(spark):
    got = parse(
        spark,
        ("host1 warn disk low", "warn"),
        ("nothing here", "warn"),
        ("a (x+ b", "(x+"),
        ("first line\nwarn second", "warn"),
    )
    assert got[0] == ("", "WARN", "disk low")
    assert got[1] == ("", "WARN", "nothing here")
    assert got[2] == ("", "(X+", "b")
    assert got[3][2] == "first line\nwarn second"


def test_line_ends_and_unicode(spark):
    got = parse(
        spark,
        ("INFO: with newline\n", ""),
        ("INFO: first\nsecond", ""),
        ("INFO:\nsecond", ""),
        ("١٢ ERROR: arabic digits", ""),
        ("ERROR: nbsp ", ""),
        ("ERROR: a b", ""),
        ("\x01\x01INFO\x01: marks \x01 kept", ""),
        ("\x01a\x01b\x01c", ""),
        ("", ""),
    )
    assert got[0] == ("", "INFO", "with newline")
    assert got[1] == ("", "UNKNOWN", "INFO: first\nsecond")
    assert got[2] == ("", "INFO", "second")
    assert got[3] == ("", "ERROR", "arabic digits")
    assert got[4] == ("", "ERROR", "nbsp")
    assert got[5] == ("", "ERROR", "a b")
    assert got[6] == ("", "INFO", "marks \x01 kept")
    assert got[7] == ("", "UNKNOWN", "\x01a\x01b\x01c")
    assert got[8] == ("", "UNKNOWN", "")


def test_mask(spark):
    cases = {
        "\x1b[1mbold\x1b[0m": "bold",
        "pid [worker-1] up": "pid <MASKED_INFO> up",
        "at com.acme.svc.Handler fails": "at <CLASS_NAME> fails",
        "blk 12_34_5 ok": "blk <COMPOSITE_ID> ok",
        "from 10.0.0.1 port": "from <IP> port",
        "id c9f0f895-fb98-ab91-59f5-1fd0297e236d.": "id <UUID>.",
        "sum 1234567890 and deadbeefcafe": "sum <HEX> and <HEX>",
        'host: "api.example.org" x': 'host: "<HOST>" x',
        "8#12: *77 done": "<PID>: <CONN_ID> done",
        "took 17 ms, v2": "took <NUM> ms, v2",
        "[a\nb] multi": "<MASKED_INFO> multi",
        "[] empty": "[] empty",
        "٣٤ units": "<NUM> units",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "m string")
    got = {r.m: r.x for r in with_masked(rows, "m", "x").collect()}
    assert got == cases
    none = with_masked(spark.sql("SELECT CAST(NULL AS STRING) AS m"), "m", "x").first()
    assert none.x == ""


def test_mask_once_is_enough_and_prefix(spark):
    rows = spark.createDataFrame([("took 17 ms from 10.0.0.1 [x]",)], "m string")
    twice = with_masked(with_masked(rows, "m", "x"), "x", "y").first()
    assert twice.x == twice.y
    framed = rows.select(mask_rule(F.col("m"), "num", "<", ">").alias("x")).first()
    assert framed.x.startswith("took <<NUM>> ms")


def test_mask_survives_a_filter_without_growing(spark):
    """A filter on the masked text must not copy the eleven rules into itself."""
    rows = spark.range(10).selectExpr("CAST(id AS STRING) AS m")
    masked = with_masked(rows, "m", "x").filter("x != ''").groupBy("x").count()
    plan = masked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 11 * 2
    assert masked.collect() == [("<NUM>", 10)]


def test_text_helpers(spark):
    row = spark.createDataFrame([("a <NUM> <b c> <<IP>> <X>\r\nz  ",)], "t string").select(
        placeholders(F.col("t")).alias("p"), single_line(F.col("t")).alias("s")
    ).first()
    assert row.p == ["<NUM>", "<IP>", "<X>"]
    assert row.s == "a <NUM> <b c> <<IP>> <X> z"


def test_dataset_key(spark):
    paths = ["file:///corpus/Hadoop/a.log", "file:///corpus/Hadoop/b.log", "file:///corpus/app.log", "file:///corpus/x/y/z.json"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r.d for r in rows.select(dataset_key(F.col("p"), "/corpus").alias("d")).collect()] == ["Hadoop", "Hadoop", "app", "x"]

"""Scans of raw log directories: text lines and JSON arrays."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logrung.functions.parsing import METADATA_FIELDS, parse_lines
from logrung.functions.text import EXTRA_LINE_BREAKS, dataset_key, is_blank
from logrung.session import landed, qualified_path
from logrung.sources.json_arrays import array_items, is_object
from logrung.sources.records import project_records

#: Lines of a block: what ranks over files count and sort at a time.
LINES_PER_BLOCK = 1_000_000

#: JSON files of more bytes are cut by many tasks.
WHOLE_FILE = 64 << 20

TEXT_GLOB = "*.[lL][oO][gG]"
JSON_GLOB = "*.[jJ][sS][oO][nN]"


def _open(
    spark: SparkSession, root: str, glob: str, name_pattern: str | None, whole: bool, separator: str | None = None
) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    if separator is not None:
        reader = reader.option("lineSep", separator)
    try:
        files = reader.text(root, wholetext=whole)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"Directory not found at {root}") from error
        raise
    if name_pattern is not None:
        files = files.filter(F.col("_metadata.file_name").rlike(name_pattern))
    return files


def _file_path() -> Column:
    """The file's path with URI escapes resolved ('+' is no escape there)."""
    return F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))


def discover_files(spark: SparkSession, root: str, name_pattern: str | None = None) -> DataFrame:
    """(file_path, kind, bytes) of all .log and .json files below ``root``.

    ``name_pattern`` is searched in the file name. Listing only: no content
    is read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    parts = []
    for kind, glob in (("log", TEXT_GLOB), ("json", JSON_GLOB)):
        try:
            files = reader.option("pathGlobFilter", glob).load(root)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                raise FileNotFoundError(f"Directory not found at {root}") from error
            raise
        if name_pattern is not None:
            files = files.filter(F.col("_metadata.file_name").rlike(name_pattern))
        parts.append(
            files.select(_file_path().alias("file_path"), F.lit(kind).alias("kind"), F.col("length").alias("bytes"))
        )
    return parts[0].unionByName(parts[1]).orderBy("file_path")


def scan_text(
    spark: SparkSession, root: str, name_pattern: str | None = None, glob: str = TEXT_GLOB
) -> DataFrame:
    """(file_path, block, pos, raw_line): one row per non-blank text line.

    ``pos`` is the line's number in its file, blank lines counted, and ``block``
    the number of its run of a million lines; neither depends on how the files
    are split or on the number of cores. Files stay splittable: one pass counts
    the lines of each split, and a line is its place in its split, shifted by
    the lines of the splits before it. No line is moved. Line breaks the reader
    does not know are split here; bytes that are not UTF-8 become U+FFFD.
    """
    lines = _open(spark, root, glob, name_pattern, whole=False).select(
        _file_path().alias("file_path"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.explode(F.split("value", EXTRA_LINE_BREAKS)).alias("raw_line"),
    )
    # Consecutive within a task, and a split is read by one task.
    placed = lines.withColumn("_at", F.monotonically_increasing_id())
    splits = landed(
        placed.groupBy("file_path", "_split").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")),
        "file-splits",
    )
    before = Window.partitionBy("file_path").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    shifted = splits.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    place = F.col("_at") - F.col("_first")
    # The second pass must split the files as the first did; settings changed in between would show here.
    checked = F.when((place >= 0) & (place < F.col("_n")), F.col("_shift") + place).otherwise(
        F.raise_error(F.lit("the files were split in another way than when they were counted"))
    )
    numbered = placed.join(shifted, ["file_path", "_split"]).withColumn("pos", checked)
    return numbered.select(
        "file_path", F.floor(F.col("pos") / LINES_PER_BLOCK).alias("block"), "pos", "raw_line"
    ).filter(~is_blank(F.col("raw_line")))


def _json_files(spark: SparkSession, root: str, name_pattern: str | None, whole_file: int) -> DataFrame:
    # One variant per item: an odd item does not spoil its neighbours, and a
    # payload that is no array (or is cut off) gives null. The brackets around
    # it make text behind the array an error, which the reader passes over at the end.
    files = _open(spark, root, JSON_GLOB, name_pattern, whole=True)
    wrapped = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<array<variant>>")
    return files.filter(F.col("_metadata.file_size") <= whole_file).select(
        _file_path().alias("file_path"),
        "value",
        F.when(F.size(wrapped) == 1, F.get(wrapped, F.lit(0))).alias("items"),
    )


def _large_arrays(
    spark: SparkSession, root: str, name_pattern: str | None, whole_file: int
) -> tuple[DataFrame, DataFrame] | None:
    """:func:`array_items` of the files above ``whole_file`` bytes, None where there are none."""
    known = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", JSON_GLOB)
    # Lengths are known from the listing; no content is read.
    if known.load(root).select("length").filter(F.col("length") > whole_file).isEmpty():
        return None
    lines = _open(spark, root, JSON_GLOB, name_pattern, whole=False, separator="}")
    return array_items(
        lines.filter(F.col("_metadata.file_size") > whole_file).select(
            _file_path().alias("file_path"), F.col("_metadata.file_block_start").alias("split"), "value"
        )
    )


def scan_json(
    spark: SparkSession, root: str, name_pattern: str | None = None, whole_file: int = WHOLE_FILE
) -> DataFrame:
    """(file_path, block, pos, raw_json): one row per object in a JSON array file.

    ``pos`` is the item's place in its array, ``block`` that of its run of a
    million. Files above ``whole_file`` bytes are cut by many tasks, smaller
    ones are a row each; the result is the same. A file that is malformed
    anywhere, or no array, gives no rows.
    """
    items = _json_files(spark, root, name_pattern, whole_file).select(
        "file_path", F.posexplode("items").alias("pos", "raw_json")
    )
    large = _large_arrays(spark, root, name_pattern, whole_file)
    if large is not None:
        cut, found = large
        sound = cut.join(found.where("sound").select("file_path"), "file_path", "left_semi")
        items = items.unionByName(sound.select("file_path", "pos", F.col("item").alias("raw_json")))
    items = items.filter(is_object(F.col("raw_json"))).withColumn("pos", F.col("pos").cast("long"))
    return items.select("file_path", F.floor(F.col("pos") / LINES_PER_BLOCK).alias("block"), "pos", "raw_json")


def load_counters(
    spark: SparkSession, root: str, name_pattern: str | None = None, whole_file: int = WHOLE_FILE
) -> DataFrame:
    """(file_path, status, items, kept, dropped) per JSON file.

    Status is ok, malformed, not_array or empty (an array without records).
    Files above ``whole_file`` bytes count as not_array by their first character.
    """
    kept = F.size(F.filter("items", is_object))
    files = _json_files(spark, root, name_pattern, whole_file).select(
        "file_path",
        F.when(F.col("items").isNotNull(), F.when(kept > 0, "ok").otherwise("empty"))
        .when(F.try_parse_json("value").isNull() | F.col("value").rlike(r"^\s*\["), "malformed")
        .otherwise("not_array")
        .alias("status"),
        F.coalesce(F.when(F.col("items").isNotNull(), F.size("items")), F.lit(0)).alias("items"),
        F.coalesce(F.when(F.col("items").isNotNull(), kept), F.lit(0)).alias("kept"),
    )
    large = _large_arrays(spark, root, name_pattern, whole_file)
    if large is not None:
        cut, found = large
        counted = cut.groupBy("file_path").agg(
            F.count("*").cast("int").alias("items"), F.count_if(is_object(F.col("item"))).cast("int").alias("kept")
        )
        kept = F.coalesce("kept", F.lit(0))
        files = files.unionByName(
            found.join(counted, "file_path", "left").select(
                "file_path",
                F.when(F.col("sound"), F.when(kept > 0, "ok").otherwise("empty"))
                .when(F.col("other"), "not_array")
                .otherwise("malformed")
                .alias("status"),
                F.when(F.col("sound"), F.coalesce("items", F.lit(0))).otherwise(0).alias("items"),
                F.when(F.col("sound"), kept).otherwise(0).alias("kept"),
            )
        )
    return files.withColumn("dropped", F.col("items") - F.col("kept"))


def scan_directory(spark: SparkSession, root: str, name_pattern: str | None = None) -> DataFrame:
    """All records below ``root``, text and JSON, in one shape.

    (file_path, block, pos, dataset, raw_line, log_timestamp, metadata,
    raw_json). JSON records whose line is no string are left out; see
    :func:`rejected_records`.
    """
    text = scan_text(spark, root, name_pattern).select(
        "file_path",
        "block",
        "pos",
        "raw_line",
        F.lit("").alias("log_timestamp"),
        F.struct(*[F.lit("").alias(name) for name in METADATA_FIELDS]).alias("metadata"),
        F.lit(None).cast("variant").alias("raw_json"),
    )
    records = project_records(scan_json(spark, root, name_pattern), "raw_json")
    records = records.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    both = text.unionByName(records.select(*text.columns))
    return both.withColumn("dataset", dataset_key(F.col("file_path"), qualified_path(spark, root)))


def rejected_records(spark: SparkSession, root: str, name_pattern: str | None = None) -> DataFrame:
    """JSON records that cannot be parsed because their line is no string."""
    records = project_records(scan_json(spark, root, name_pattern), "raw_json")
    return records.filter(F.col("reject_reason").isNotNull()).select(
        "file_path", "pos", "reject_reason", F.to_json("raw_json").alias("raw_json")
    )


def scan_parsed(spark: SparkSession, root: str, name_pattern: str | None = None) -> DataFrame:
    """:func:`scan_directory` with line_timestamp, line_level and message."""
    rows = scan_directory(spark, root, name_pattern)
    return parse_lines(
        rows.withColumn("_detected", F.col("metadata.detected_level")), "raw_line", "_detected"
    ).drop("_detected")


def scan_counts(entries: DataFrame) -> DataFrame:
    """(entries, files): loaded records and files with at least one."""
    return entries.groupBy("file_path").agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("entries"), F.count("*").alias("files")
    )

"""Line parser: timestamp, level and message of a raw log line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logrung.functions.levels import UNKNOWN
from logrung.functions.text import computed_once, replace_pattern, strip

# White space, timestamp, level words and the two line shapes.
_WS = r"[\s\x1c-\x1f]"
_CLOCK = r"\d{4}-\d{2}-\d{2}(?:T|" + _WS + r")\d{2}:\d{2}:\d{2}(?:[.,]\d+)?" + _WS + r"*"
TIMESTAMP = _CLOCK + r"(?:[+-]\d{4}|Z)?"
LEVEL_WORDS = (
    "TRACE|VERBOSE|VERB|DEBUG|DBG|FINEST|FINER|FINE|WARNING|WARN|WRN|ERROR|SEVERE|ERR|"
    "CRITICAL|CRIT|EMERGENCY|EMERG|DPANIC|PANIC|FATAL|ALERT|NOTICE|INFO"
)
STRICT_LINE = (
    r"^(?:.*?(" + TIMESTAMP + r"))?.*?\b(" + LEVEL_WORDS + r"|[TVDIWEF])\b"
    r".*?(?:---|:|" + _WS + r"-" + _WS + r"|\])" + _WS + r"*(.*)$"
)
_HEADER = r"(?:^|" + _WS + r")[A-Z0-9][A-Z0-9_:\-./]+" + _WS + r"+(" + LEVEL_WORDS + r")" + _WS + r"+"
LOOSE_LINE = r"^(?:.*?(" + TIMESTAMP + r"))?.*?" + _HEADER + r"(.*)$"
METADATA_FIELDS = (
    "app", "container", "detected_level", "filename", "job",
    "namespace", "node_name", "pod", "service_name", "stream",
)

_MARK = "\x01"
_GROUPS = f"{_MARK}$1{_MARK}$2{_MARK}$3"


def _three_groups(line: Column, pattern: str, flags: str = "") -> Column:
    """Rewrite a matching line as MARK ts MARK level MARK message.

    One regex pass yields all three groups. A line that does not match comes
    back unchanged, and a match never equals its line: the character before
    the message is a delimiter or white space there and a MARK here.
    """
    return replace_pattern(line, pattern, _GROUPS, flags)


#: Beyond this length a line goes through steps that each read it once.
LONG_LINE = 1000
_DELIMITER = r"(?:---|:|" + _WS + r"-" + _WS + r"|\])"
_LEVEL = r"\b(" + LEVEL_WORDS + r"|[TVDIWEF])\b"


def _strict_groups(line: Column) -> Column:
    """The strict shape, as :func:`_three_groups` gives it, in linear time for long lines.

    As one pattern it reads the rest of the line again for each level word and
    each timestamp. A match needs a level before the last delimiter, and takes
    the first timestamp before the last such level, the first level after that
    timestamp and the first delimiter after that level. So the last ones are
    found first, each by one greedy pass, and nothing after that can fail. Lines
    with an inner line break keep the one pattern: few parts of it cross a break.
    """
    flags = "(?idU)"
    # ``last`` ends before the last delimiter, ``early`` before the last level in it.
    last = F.regexp_extract(line, f"{flags}^(.*){_DELIMITER}", 1)
    level_in = f"{flags}^(.*){_LEVEL}"
    early = F.regexp_extract(last, level_in, 1)
    stamp = F.regexp_extract(early, f"{flags}({TIMESTAMP})", 1)
    # One character before the rest stands for what a word boundary sees there.
    rest = F.when(
        stamp != "", F.substring(line, F.instr(line, stamp) + F.length(stamp) - 1, F.length(line))
    ).otherwise(F.concat(F.lit(" "), line))
    parts = F.regexp_replace(
        rest, f"{flags}^.(?:.*?){_LEVEL}.*?{_DELIMITER}{_WS}*(.*)$", f"$1{_MARK}$2"
    )
    found = F.concat(F.lit(_MARK), stamp, F.lit(_MARK), parts)
    stepwise = F.when(last.rlike(level_in), found).otherwise(line)
    short = (F.length(line) <= LONG_LINE) | F.contains(line, F.lit("\n"))
    return F.when(short, _three_groups(line, STRICT_LINE, "i")).otherwise(stepwise)


def _loose_groups(line: Column) -> Column:
    """The loose shape, as :func:`_three_groups` gives it, in linear time for long lines.

    A header and level after the first timestamp are after every shorter form
    of it too, and after no later timestamp unless after the first. So one pass
    finds the first timestamp and one the first header behind it. Where there
    is none, the timestamp may have taken the blank before the header: it gives
    back its zone and one blank. Else the line has no timestamp that counts.
    """
    flags = "(?dU)"
    stamp = F.regexp_extract(line, f"{flags}({TIMESTAMP})", 1)
    clock = F.regexp_extract(line, f"{flags}({_CLOCK})", 1)
    less = F.substring(clock, F.lit(1), F.length(clock) - 1)

    def after(taken: Column) -> Column:
        return F.substring(line, F.instr(line, taken) + F.length(taken), F.length(line))

    def parts(before: Column, rest: Column) -> Column:
        behind = F.regexp_replace(rest, f"{flags}^.*?{_HEADER}(.*)$", f"$1{_MARK}$2")
        return F.concat(F.lit(_MARK), before, F.lit(_MARK), behind)

    header = f"{flags}{_HEADER}"
    # A character that no header holds: the rest does not begin a line.
    rest = F.concat(F.lit("x"), after(stamp))
    stepwise = (
        F.when((stamp != "") & rest.rlike(header), parts(stamp, rest))
        .when(clock.rlike(f"{flags}{_WS}$") & after(less).rlike(header), parts(less, after(less)))
        .when(line.rlike(header), parts(F.lit(""), line))
        .otherwise(line)
    )
    short = (F.length(line) <= LONG_LINE) | F.contains(line, F.lit("\n"))
    return F.when(short, _three_groups(line, LOOSE_LINE)).otherwise(stepwise)


def _group(rewritten: Column, n: int) -> Column:
    # Neither a timestamp nor a level can hold the mark, so the fourth part
    # is the whole message even when the message holds marks of its own.
    return F.element_at(F.split(rewritten, _MARK, 4), n + 1)


def parse_strict(df: DataFrame, line: str, target: str) -> DataFrame:
    """Append the strict parse as a struct, null where the shape differs."""
    return _parse_into(df, F.col(line), target, _strict_groups(F.col(line)))


def parse_loose(df: DataFrame, line: str, target: str) -> DataFrame:
    """Append the loose parse (upper-case level inside a header)."""
    return _parse_into(df, F.col(line), target, _loose_groups(F.col(line)))


def _parse_into(df: DataFrame, line: Column, target: str, groups: Column) -> DataFrame:
    rewritten = df.withColumn("_rewritten", groups)
    r = F.col("_rewritten")
    return rewritten.withColumn(
        target,
        F.when(
            r != line,
            F.struct(
                _group(r, 1).alias("line_timestamp"),
                _group(r, 2).alias("line_level"),
                strip(_group(r, 3)).alias("message"),
            ),
        ),
    ).drop("_rewritten")


def strip_leaked_level(message: Column, level: Column) -> Column:
    """Remove everything up to and including the first mention of ``level``.

    Optional brackets and one delimiter after it go too. The level is quoted,
    so that regex characters in metadata are read as text.
    """
    quoted = F.concat(F.lit("\\Q"), F.replace(level, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pattern = F.concat(
        F.lit(r"(?idU)^.*?\[?"), quoted, F.lit(rf"\]?{_WS}*(?:-|:|\])?{_WS}*")
    )
    return strip(F.regexp_replace(message, pattern, F.lit("")))


def parse_lines(df: DataFrame, line: str = "raw_line", detected: str | None = None) -> DataFrame:
    """Append line_timestamp, line_level and message to every row.

    Tries the strict shape, then the loose one. A line with neither takes its
    level from the metadata column ``detected`` (if given and set), else
    UNKNOWN, and keeps its text, less a leaked metadata level.
    """
    text = F.col(line)
    rows = df.withColumn("_strict", _strict_groups(text))
    rows = rows.withColumn(
        "_hit",
        F.when(F.col("_strict") != text, F.col("_strict")).otherwise(
            F.nullif(_loose_groups(text), text)
        ),
    )
    rows = rows.withColumn("_parts", F.split("_hit", _MARK, 4))
    given = F.upper(F.coalesce(F.col(detected), F.lit(""))) if detected else F.lit("")
    rows = rows.withColumn(
        "line_level",
        F.when(F.col("_hit").isNotNull(), F.element_at("_parts", 3)).otherwise(
            F.when(given != "", given).otherwise(F.lit(UNKNOWN))
        ),
    )
    kept = strip(F.coalesce(F.element_at("_parts", 4), text))
    level = F.col("line_level")
    leaked = F.col("_hit").isNull() & (level != UNKNOWN)
    return computed_once(
        rows,
        {
            "line_timestamp": F.coalesce(F.element_at("_parts", 2), F.lit("")),
            "line_level": level,
            "message": F.when(leaked, strip_leaked_level(kept, level)).otherwise(kept),
        },
    ).drop("_strict", "_hit", "_parts")


def metadata_struct(raw: Column) -> Column:
    """The ten known metadata fields of a JSON object given as text.

    Unknown keys are ignored; missing keys and missing objects become ''.
    """
    parsed = F.from_json(raw, ", ".join(f"{name} string" for name in METADATA_FIELDS))
    return F.struct(
        *[F.coalesce(parsed[name], F.lit("")).alias(name) for name in METADATA_FIELDS]
    )

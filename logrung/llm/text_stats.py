"""Statistics of whole texts as columns, the inputs of the quality operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logrung.llm.draws import draw, share
from logrung.llm.encode import give_back_memory
from logrung.llm.words import text_slices, window_hashes, words_of

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = (
    "mean_word",
    "symbol_share",
    "dup_line_share",
    "repeat_share",
    "same_as_last_share",
    "upper_share",
    "digit_share",
    "mark_share",
    "shout_share",
    "stop_share",
    "wide_share",
    "words_per_line",
)
STATS = COUNTS + SHARES
_WINDOW = 5
_SPACE = " \t\n\v\f\r"


def _table(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


_CLASSES = {
    "symbol": _table("#*$%&|<>"),
    "upper": _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "lower": _table("abcdefghijklmnopqrstuvwxyz"),
    "digit": _table("0123456789"),
    "mark": _table(".,;:!?\"'()[]{}-_/\\@^~`+="),
    "shout": _table("!?"),
    "stop": _table("."),
    "line": _table("\n"),
}
#: First byte of every character beyond ASCII.
_CLASSES["wide"] = np.zeros(256, bool)
_CLASSES["wide"][0xC0:] = True


def _repeated_words(words: np.ndarray) -> int:
    """Words that lie in a window of five words which occurs twice or more in the text."""
    windows = window_hashes(words, _WINDOW)
    if len(windows) < 2:
        return 0
    _, inverse, count = np.unique(windows, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[inverse] > 1)
    if not len(at):
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    cover[at] += 1
    cover[at + _WINDOW] -= 1
    return int(np.count_nonzero(np.cumsum(cover)))


def _duplicate_lines(text: str) -> tuple[int, int]:
    """(lines with a word that equal an earlier line, lines with a word)."""
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    return len(lines) - len(set(lines)), len(lines)


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """A column of each statistic; null texts count as empty, whose statistics are all 0."""
    n = len(texts)
    out = {name: np.zeros(n, np.int64) for name in COUNTS} | {name: np.zeros(n) for name in SHARES}
    texts = texts.cast(pa.large_string()).fill_null("")
    for first, last in text_slices(texts):
        here = slice(first, last)
        part = texts.slice(first, last - first)
        words = words_of(part)
        n_words = np.diff(words.bounds)
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        edges = offsets - offsets[0]
        count = {
            name: np.diff(np.concatenate(([0], np.cumsum(table[data])))[edges]).astype(float)
            for name, table in _CLASSES.items()
        }
        last_same = np.zeros(len(words.hashes) + 1, np.int64)
        if len(words.hashes):
            same = words.hashes[1:] == words.hashes[:-1]
            inner = words.bounds[(words.bounds > 0) & (words.bounds < len(words.hashes))]
            same[inner - 1] = False
            last_same[2:] = np.cumsum(same)
        repeats = np.zeros(last - first, np.int64)
        dup, lines = np.zeros(last - first, np.int64), np.zeros(last - first)
        for i, text in enumerate(part.to_pylist()):
            own = words.hashes[words.bounds[i] : words.bounds[i + 1]]
            repeats[i] = _repeated_words(own)
            dup[i], lines[i] = _duplicate_lines(text)
        some_words, some_lines = np.maximum(n_words, 1), np.maximum(lines, 1)
        some_chars = np.maximum(words.chars, 1)
        letters = np.maximum(count["upper"] + count["lower"] + count["wide"], 1)
        out["n_words"][here] = n_words
        out["word_chars"][here] = words.chars
        out["n_symbols"][here] = count["symbol"]
        out["n_dup_lines"][here] = dup
        out["n_repeat_words"][here] = repeats
        out["mean_word"][here] = words.chars / some_words
        out["symbol_share"][here] = count["symbol"] / some_chars
        out["dup_line_share"][here] = dup / some_lines
        out["repeat_share"][here] = repeats / some_words
        out["same_as_last_share"][here] = (last_same[words.bounds[1:]] - last_same[words.bounds[:-1]]) / some_words
        out["upper_share"][here] = count["upper"] / letters
        out["digit_share"][here] = count["digit"] / some_chars
        out["mark_share"][here] = count["mark"] / some_chars
        out["shout_share"][here] = count["shout"] / some_words
        out["stop_share"][here] = count["stop"] / some_words
        out["wide_share"][here] = count["wide"] / letters
        out["words_per_line"][here] = n_words / some_lines
    return out


STATS_TYPE = T.StructType(
    [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField(c, T.DoubleType()) for c in SHARES]
)


@F.arrow_udf(STATS_TYPE)
def text_stats(texts: pa.Array) -> pa.Array:
    """A struct of all statistics of each text."""
    found = statistics(texts)
    give_back_memory(cycles=False)
    return pa.StructArray.from_arrays([pa.array(found[name]) for name in STATS], names=list(STATS))


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one more column, the struct ``_stats``."""
    return docs.withColumn("_stats", text_stats(F.col(text).cast("string")))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds))


def label_marks(labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(doc_id, label): at most about ``limit`` ids with label 0 or 1, drawn by a hash of the id.

    The bound keeps a fit on the driver small whatever the table's size; all
    ids enter below it. Ids with several labels take the smallest; null ids,
    null labels and other values are left out.
    """
    marked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where("doc_id is not null and label in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
    )
    total = marked.count()
    if total > limit:
        # The same share of the hash range for every label.
        marked = marked.where(draw("doc_id", F.lit(5)) < share(limit, total))
    return marked


def labelled_sample(stats: DataFrame, marks: DataFrame) -> pd.DataFrame:
    """The statistics (doc_id, STATS) of marked rows with their ``label``, one for each id, in a fixed order."""
    rows = stats.join(marks, "doc_id").select("doc_id", "label", *STATS).toPandas()
    rows = rows.sort_values(["doc_id", *STATS], kind="stable")
    return rows.drop_duplicates("doc_id", ignore_index=True)

"""JSON array files of any size, read by many tasks.

A file is read in splits that begin after a ``}``. Whether a split begins
inside a string, and how deep, follows from the splits before it: a first pass
sums up each split (whether its quotes are odd in number, and by how much it
changes the depth for either start), prefix sums over splits give the state at
each one's start, and a second pass cuts the splits at the commas of the
outermost array. An item that crosses splits is put together from its parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logrung.session import landed

_QUOTE, _BACKSLASH, _COMMA = ord('"'), ord("\\"), ord(",")
_STEP = np.zeros(256, np.int64)
_STEP[[ord("["), ord("{")]] = 1
_STEP[[ord("]"), ord("}")]] = -1
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0D]] = True
#: Bytes that a task looks at together.
AT_ONCE = 8 << 20
#: Starts of splits, a row of some 60 bytes each, are broadcast up to this many.
MOST_BROADCAST = 500_000

_PARTS = "file_path string, split long, at long, kind string, text string"


class _Lexer:
    """Strings and depth of a run of bytes, piece after piece."""

    def __init__(self, in_string: bool = False, depth: int = 0):
        self.in_string, self.depth, self._escaped = in_string, depth, False

    def quotes(self, data: np.ndarray) -> np.ndarray:
        """Which bytes are quotes that no backslash escapes."""
        quote = data == _QUOTE
        back = np.flatnonzero(data == _BACKSLASH)
        if len(back) or self._escaped:
            # A backslash escapes what follows unless it is escaped itself: in a run every second one.
            first = np.ones(len(back), bool)
            first[1:] = np.diff(back) > 1
            begin = back[first]
            odd = np.diff(np.append(np.flatnonzero(first), len(back))) % 2 == 1
            end = begin + np.diff(np.append(np.flatnonzero(first), len(back)))
            if self._escaped:
                if len(begin) and begin[0] == 0:
                    odd[0] = ~odd[0]
                elif len(data):
                    quote[0] = False
            inner = odd & (end < len(data))
            quote[end[inner]] = False
            self._escaped = bool(len(odd) and odd[-1] and end[-1] == len(data)) if len(data) else self._escaped
        return quote

    def feed(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(outside, depth): bytes outside of strings, and the depth after each byte."""
        quote = self.quotes(data)
        inside = (np.cumsum(quote) + self.in_string) % 2 == 1
        outside = ~inside & ~quote
        depth = self.depth + np.cumsum(np.where(outside, _STEP[data], 0))
        if len(data):
            self.in_string, self.depth = bool(inside[-1]), int(depth[-1])
        return outside, depth


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """((file, split, further columns), bytes in pieces) of each split of a task, in order."""
    key, held, size = None, [], 0
    for batch in batches:
        extra = [batch.column(i).to_pylist() for i in range(3, batch.num_columns)]
        rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), *extra, strict=True)
        for path, split, value, *rest in rows:
            text = np.frombuffer(value.as_buffer() or b"", np.uint8)
            own = (path, split, *rest)
            if own != key:
                if key is not None:
                    yield key, held
                    yield key, []
                key, held, size = own, [], 0
                # The reader took the bracket that ended the row before; a file's first row has none before it.
                if split:
                    held.append(np.array([ord("}")], np.uint8))
            else:
                held.append(np.array([ord("}")], np.uint8))
            held.append(text)
            size += len(text)
            if size >= AT_ONCE:
                yield key, held
                held, size = [], 0
    if key is not None:
        yield key, held
        yield key, []


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split: whether its quotes are odd, and the change of depth from either start."""
    lexer, odd, change, turned = _Lexer(), 0, 0, 0
    for key, pieces in _runs(batches):
        if pieces:
            data = np.concatenate(pieces)
            quote = lexer.quotes(data)
            inside = (np.cumsum(quote) + odd) % 2 == 1
            step = np.where(quote, 0, _STEP[data])
            change += int(step[~inside].sum())
            turned += int(step[inside].sum())
            odd = (odd + int(quote.sum())) % 2
            continue
        yield pa.RecordBatch.from_pydict(
            {"file_path": [key[0]], "split": [key[1]], "odd": [odd], "change": [change], "turned": [turned]}
        )
        lexer, odd, change, turned = _Lexer(), 0, 0, 0


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut splits whose start is known. ``at`` counts the cuts of a split.

    Kinds: ``item`` between two cuts; ``part``, which goes on in another
    split; ``cut``, one for each split, whose ``at`` is their number; ``open``,
    one for each opening bracket outside; ``other``, a file that does not begin
    with one; ``bad``, where what is outside the items breaks the form of an array.
    """
    lexer, left, at, whole, begun = None, np.zeros(0, np.uint8), 0, False, True
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        made[4] = made[4].view(pa.string())
        rows.clear()
        return pa.RecordBatch.from_arrays(made, names=["file_path", "split", "at", "kind", "text"])

    for (path, split, in_string, depth), pieces in _runs(batches):
        if lexer is None:
            lexer, left, at, whole, begun = _Lexer(bool(in_string), depth), np.zeros(0, np.uint8), 0, False, split > 0
        if pieces:
            data = np.concatenate(pieces)
            if not begun:
                text = data[~_BLANK[data]]
                begun = len(text) > 0
                if begun and text[0] != ord("["):
                    rows.append((path, split, 0, "other", None))
            before = lexer.depth
            outside, level = lexer.feed(data)
            was = np.concatenate(([before], level[:-1])) if len(level) else level
            top = outside & (
                ((data == _COMMA) & (level == 1)) | ((level == 1) & (was == 0)) | ((level == 0) & (was == 1))
            )
            wrong = ((level == 0) & (was == 0) & ~_BLANK[data]) | (level < 0)
            wrong |= top & (level == 1) & (was == 0) & (data != ord("["))
            wrong |= top & (level == 0) & (was == 1) & (data != ord("]"))
            if wrong.any():
                rows.append((path, split, 0, "bad", None))
            opens = int((top & (was == 0) & (level == 1)).sum())
            rows += [(path, split, 0, "open", None)] * opens
            begin = 0
            for cut in np.flatnonzero(top).tolist():
                text = np.concatenate((left, data[begin:cut])).tobytes()
                # Before the opening bracket there is nothing, and an item that this split did not begin goes on.
                if was[cut] > 0:
                    rows.append((path, split, at, "item" if whole else "part", text))
                left, begin, whole = np.zeros(0, np.uint8), cut + 1, True
                at += 1
                if len(rows) >= 1000:
                    yield batch()
            left = np.concatenate((left, data[begin:]))
            continue
        if lexer.depth > 0 or lexer.in_string:
            rows.append((path, split, at, "part", left.tobytes()))
        rows.append((path, split, at, "cut", None))
        yield batch()
        lexer = None


def array_items(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, files) of JSON array files, given as (file_path, split, value).

    ``value`` are the rows of a text reader with ``}`` as line separator,
    those of a split in order, and ``split`` is where it begins in its file.
    Items: (file_path, pos, item), item a VARIANT, null where it is no JSON.
    Files: (file_path, sound, other), whether all of it is one array, and
    whether it does not begin as one. Both come from one written table; files
    that are not sound still give items.
    """
    sums = landed(
        lines.select("file_path", "split", "value").mapInArrow(_sums, "file_path string, split long, odd long, change long, turned long"),
        "json-splits",
    )
    before = Window.partitionBy("file_path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    known = sums.withColumn("in_string", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    change = F.when(F.col("in_string") == 0, F.col("change")).otherwise(F.col("turned"))
    starts = landed(
        known.withColumn("change", change)
        .withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
        .select("file_path", "split", "in_string", "depth"),
        "json-starts",
    )
    # Rows of a split must stay in order: a broadcast join moves none, beyond it they are sorted.
    placed = lines.select("file_path", "split", "value")
    if starts.count() <= MOST_BROADCAST:
        placed = placed.join(F.broadcast(starts), ["file_path", "split"])
    else:
        numbered = placed.withColumn("_at", F.monotonically_increasing_id())
        placed = numbered.join(starts, ["file_path", "split"]).sortWithinPartitions("file_path", "split", "_at")
    parts = landed(
        placed.select("file_path", "split", "value", "in_string", "depth")
        .mapInArrow(_parts, _PARTS)
        .withColumn("item", F.when(F.col("kind") == "item", F.try_parse_json("text")))
        .withColumn("blank", F.trim(F.translate("text", "\t\r\n", "   ")) == "")
        .withColumn("text", F.when(F.col("kind") == "part", F.col("text"))),
        "json-parts",
    )
    cuts = parts.where("kind = 'cut'").withColumn("shift", F.coalesce(F.sum("at").over(before), F.lit(0)))
    cuts = landed(cuts.select("file_path", "split", "shift"), "json-cuts")
    # The opening bracket is the first cut, so items count from one cut on.
    pos = (F.col("at") + F.col("shift") - 1).alias("pos")
    whole = parts.where("kind = 'item'").join(cuts, ["file_path", "split"]).select("file_path", pos, "item", "blank")
    pieces = parts.where("kind = 'part'").join(cuts, ["file_path", "split"]).select("file_path", pos, "split", "text")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("split", "text"))), lambda x: x["text"]), "")
    joined = pieces.groupBy("file_path", "pos").agg(text.alias("text"))
    joined = joined.select(
        "file_path", "pos", F.try_parse_json("text").alias("item"), (F.trim(F.translate("text", "\t\r\n", "   ")) == "").alias("blank")
    )
    items = landed(whole.unionByName(joined), "json-items")
    form = parts.groupBy("file_path").agg(
        F.count_if(F.col("kind") == "bad").alias("bad"),
        F.count_if(F.col("kind") == "open").alias("opens"),
        F.bool_or(F.col("kind") == "other").alias("other"),
    )
    ends = sums.groupBy("file_path").agg(F.sum("odd").alias("odd")).join(
        starts.join(sums, ["file_path", "split"])
        .groupBy("file_path")
        .agg(F.sum(F.when(F.col("in_string") == 0, F.col("change")).otherwise(F.col("turned"))).alias("depth")),
        "file_path",
    )
    found = items.groupBy("file_path").agg(
        F.count("*").alias("n"), F.count_if("blank").alias("blank"), F.count_if(F.col("item").isNull() & ~F.col("blank")).alias("broken")
    )
    empty = (F.col("n") == 1) & (F.col("blank") == 1)
    sound = (F.col("bad") == 0) & (F.col("opens") == 1) & (F.col("odd") % 2 == 0) & (F.col("depth") == 0)
    sound &= (F.coalesce("broken", F.lit(0)) == 0) & ((F.coalesce("blank", F.lit(0)) == 0) | empty)
    files = form.join(ends, "file_path").join(found, "file_path", "left").select("file_path", sound.alias("sound"), "other")
    return items.where("NOT blank").select("file_path", "pos", "item"), landed(files, "json-sound")


def is_object(item: Column) -> Column:
    """Whether a VARIANT is an object."""
    return F.schema_of_variant(item).startswith("OBJECT")

"""Fill-in-the-middle over a learned rank index.

Cuts are given in code points, texts are stored as UTF-8. A rank index maps
the rank of a code point to its byte offset: linear segments whose error is
bounded are fitted to all boundary offsets of a run of texts, a cut is
predicted by its segment, and the stored residual of that boundary makes the
prediction exact. Texts are then cut as bytes, without decoding them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logrung.llm.words import text_slices

#: Sentinels before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Bound of a segment's error in bytes; residuals take one byte each.
MOST_ERROR = 100
#: Boundaries under one segment before it is halved.
FIRST_LENGTH = 4096


class RankIndex:
    """Byte offsets of boundaries by rank: segments with bounded error, and residuals."""

    def __init__(self, offsets: np.ndarray, most_error: int = MOST_ERROR, first_length: int = FIRST_LENGTH):
        """Fit ``offsets``, which must ascend strictly.

        A segment runs straight from its first boundary to the one after its
        last. Segments begin with ``first_length`` boundaries, and those whose
        worst error is above ``most_error`` are halved until none is left; one
        boundary has no error, so this ends.
        """
        if not 0 <= most_error <= 127:
            raise ValueError("residuals are single bytes")
        n = len(offsets)
        starts, lengths = np.arange(0, n, first_length), np.full(-(-n // first_length), first_length)
        if n:
            lengths[-1] = n - starts[-1]
        kept: list[tuple[np.ndarray, ...]] = []
        self.residuals = np.zeros(n, np.int8)
        while len(starts):
            ends = np.minimum(starts + lengths, n - 1)
            rise = offsets[ends] - offsets[starts]
            run = np.maximum(ends - starts, 1)
            first = np.cumsum(lengths) - lengths
            step = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
            rank = np.repeat(starts, lengths) + step
            error = offsets[rank] - np.repeat(offsets[starts], lengths) - step * np.repeat(rise, lengths) // np.repeat(run, lengths)
            fits = np.maximum.reduceat(np.abs(error), first) <= most_error
            good = np.repeat(fits, lengths)
            self.residuals[rank[good]] = error[good]
            kept.append((starts[fits], offsets[starts[fits]], rise[fits], run[fits]))
            starts, lengths = starts[~fits], lengths[~fits]
            half = lengths // 2
            starts, lengths = np.concatenate((starts, starts + half)), np.concatenate((half, lengths - half))
        parts = [np.concatenate(c) if kept else np.zeros(0, np.int64) for c in zip(*kept, strict=True)] or [np.zeros(0, np.int64)] * 4
        order = np.argsort(parts[0])
        self.starts, self.bases, self.rises, self.runs = (c[order] for c in parts)

    def __len__(self) -> int:
        return len(self.residuals)

    def predicted(self, ranks: np.ndarray) -> np.ndarray:
        """The offsets that the segments give; each is wrong by no more than the bound."""
        at = np.searchsorted(self.starts, ranks, "right") - 1
        return self.bases[at] + (ranks - self.starts[at]) * self.rises[at] // self.runs[at]

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """The exact byte offsets of boundaries."""
        return self.predicted(ranks) + self.residuals[ranks]


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """The first four groups of eight digits of the hex sha256 of ``seed:doc_id``, as long."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _transformer(sentinels: tuple[str, str, str], fim_percent: int, spm_percent: int):
    marks = [s.encode() for s in sentinels]

    def transform(texts: pa.Array, draws: list[np.ndarray], known: np.ndarray) -> pa.RecordBatch:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
        edges = edges - edges[0]
        bounds = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        first = np.searchsorted(bounds, edges)
        index = RankIndex(bounds)
        n = np.diff(first)
        plain = (n == 0) | (draws[2] % 100 >= fim_percent) | ~known
        for s in sentinels:
            plain |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        spm = ~plain & (draws[3] % 100 < spm_percent)
        x, y = draws[0] % (n + 1), draws[1] % (n + 1)
        low, high = np.minimum(x, y), np.maximum(x, y)
        a, b = index.offsets(first[:-1] + low), index.offsets(first[:-1] + high)
        view, out = memoryview(data), []
        for begin, p, q, end, as_is, spm_form in zip(
            *(c.tolist() for c in (edges[:-1], a, b, edges[1:], plain, spm)), strict=True
        ):
            if as_is:
                out.append(view[begin:end])
            elif spm_form:
                out += (marks[1], view[q:end], marks[0], view[begin:p], marks[2], view[p:q])
            else:
                out += (marks[0], view[begin:p], marks[1], view[q:end], marks[2], view[p:q])
        ends = np.cumsum(np.diff(edges) + np.where(plain, 0, sum(map(len, marks))))
        offsets = np.concatenate(([0], ends)).astype(np.int64)
        form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(n.astype(np.int64)),
                pa.array(form.tolist(), pa.string()),
                pa.array(low.astype(np.int64), mask=plain),
                pa.array((high - low).astype(np.int64), mask=plain),
                pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(b"".join(out))).cast(pa.string()),
            ],
            names=["n", "form", "prefix_chars", "middle_chars", "output"],
        )

    return transform


def fill_in_middle(
    docs: DataFrame,
    seed: int = 1,
    fim_percent: int = 90,
    spm_percent: int = 20,
    sentinels: tuple[str, str, str] = SENTINELS,
    slice_bytes: int = 1 << 21,
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of ``docs`` (doc_id, text).

    Two cuts among the n code points, and the form, are drawn from a hash of
    seed and doc_id, so reruns agree and rows that repeat an id are cut alike
    where their texts are. ``plain`` texts stay as they are: empty and null
    ones, those that hold a sentinel, those of a null id, and the share that
    ``fim_percent`` leaves. Else ``psm`` is prefix, suffix, middle and ``spm``
    suffix, prefix, middle, each after its sentinel; cut sizes are null for
    plain. Row-local, no shuffle: whole texts in runs of about ``slice_bytes``,
    a longer text alone. An empty table gives no rows; other columns of
    ``docs`` are not read.
    """
    transform = _transformer(sentinels, fim_percent, spm_percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            draws = [pc.fill_null(batch.column(i), 0).to_numpy(zero_copy_only=False) for i in range(2, 6)]
            for first, last in text_slices(batch.column(1), slice_bytes):
                done = transform(
                    batch.column(1).slice(first, last - first), [d[first:last] for d in draws], known[first:last]
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), *done.columns], names=["doc_id", *done.schema.names]
                )

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(
        doc_id.alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        *[h.alias(f"h{i}") for i, h in enumerate(_draws(doc_id, seed), 1)],
    )
    return rows.mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of this form was made from.

    A transformed text holds no sentinel of its own, and none can arise across
    a seam since each begins with a character that ends none, so the first
    place of each sentinel is the true one.
    """
    p, s, m = sentinels

    def between(begin: str, end: str | None) -> Column:
        first = F.instr(output, begin) + len(begin)
        length = F.length(output) if end is None else F.instr(output, end) - first
        return F.substring(output, first, length)

    return (
        F.when(form == "psm", F.concat(between(p, s), between(m, None), between(s, m)))
        .when(form == "spm", F.concat(between(p, m), between(m, None), between(s, p)))
        .otherwise(output)
    )

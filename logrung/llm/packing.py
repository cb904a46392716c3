"""Best-fit-decreasing packing of token pieces into sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logrung.llm.encode import encoder_of, giving_back
from logrung.llm.words import text_slices
from logrung.session import landed

CAPACITY = 2048
#: Pieces packed together by one task. More groups cost at most a few part-filled sequences each.
PIECES_PER_GROUP = 16_384
#: Bytes of text encoded at a time, a longer text alone: two megabytes took 57 MB more of a worker's memory.
TEXT_AT_ONCE = 1 << 19

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = _PIECES + ", sequence_id long, offset long"


class OpenBins:
    """Open bins under a segment tree over remaining capacities.

    Leaf r counts the open bins with r places left; an inner node counts
    those below it. The tightest bin for a piece is the first non-empty leaf
    at or right of the piece's length, found in logarithmic time.
    """

    def __init__(self, capacity: int):
        self._leaves = 1 << capacity.bit_length()
        self._tree = [0] * (2 * self._leaves)
        self._bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, bin_id: int, remaining: int) -> None:
        """Open a bin, or put one back with its new remaining capacity; full bins are closed."""
        if remaining <= 0:
            return
        self._bins[remaining].append(bin_id)
        self._count(remaining, 1)

    def _count(self, remaining: int, by: int) -> None:
        node = remaining + self._leaves
        while node:
            self._tree[node] += by
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Remove the tightest open bin that holds ``length``: (bin, remaining), else None."""
        node = length + self._leaves
        tree = self._tree
        while not tree[node]:
            # Up to the first ancestor that is a left child, then over to its right sibling.
            while node & 1:
                node >>= 1
            if node == 0:
                return None
            node += 1
        while node < self._leaves:
            node <<= 1
            if not tree[node]:
                node += 1
        remaining = node - self._leaves
        self._count(remaining, -1)
        return self._bins[remaining].pop(), remaining


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, which must descend; bins count from 0."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins, made = OpenBins(capacity), 0
    for i, length in enumerate(lengths.tolist()):
        found = open_bins.take(length)
        if found is None:
            found, made = (made, capacity), made + 1
        bins[i], offsets[i] = found[0], capacity - found[1]
        open_bins.add(found[0], found[1] - length)
    return bins, offsets


def token_pieces(
    docs: DataFrame, path: str, spaces_kept: bool, end_id: int, capacity: int = CAPACITY
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids with the end id.

    Only documents above the capacity are cut, into pieces of the capacity;
    the last piece is what is left. A null text is empty: one piece, the end
    id. Repeated rows give repeated pieces. Row-local, no shuffle.
    """

    @giving_back
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, spaces_kept)
        for batch in batches:
            for first, last in text_slices(batch.column(1), TEXT_AT_ONCE):
                ids, counts = encoder.encode(batch.column(1).slice(first, last - first))
                ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
                lengths = counts + 1
                many = -(-lengths // capacity)
                owner = np.repeat(np.arange(last - first), many)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                size = np.minimum(lengths[owner] - start, capacity)
                ends = np.cumsum(size)
                view = memoryview(ids).cast("B")
                sums = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(owner + first)),
                        pa.array(piece.astype(np.int32)),
                        pa.array(start),
                        pa.array(size),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, _PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_group: int = PIECES_PER_GROUP) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of at most ``capacity``.

    Pieces are dealt to groups of about ``per_group`` rows by a hash of their
    row number (not of their values, so repeated rows do not pile up), and each
    group is packed by best-fit decreasing; ties go by doc_id, piece and
    checksum. Only lengths and checksums move. A sequence belongs to one group,
    so ids of sequences are unique: the group in the upper bits.
    """
    numbered = landed(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-numbered.count() // per_group))

    def pack_group(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(
            [("length", "descending")]
            + [(c, "ascending") for c in ("doc_id", "piece", "ids_crc32", "row")]
        )
        bins, offsets = best_fit_decreasing(rows["length"].to_numpy(), capacity)
        return (
            rows.append_column("sequence_id", pa.array((rows["group"].to_numpy() << 32) + bins))
            .append_column("offset", pa.array(offsets))
            .drop_columns(["row", "group"])
        )

    dealt = numbered.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("long"))
    return dealt.groupBy("group").applyInArrow(pack_group, _PACKED)

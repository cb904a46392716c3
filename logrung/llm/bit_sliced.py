"""Exact top-k search by inner product over a bit-sliced index.

A block of vectors is held as bitmaps: bit b of attribute j over all rows is
one slice. A query multiplies by shifting and adds slices with bitmap
arithmetic, which gives the slices of all scores of the block; the best rows
come from walking the score slices from the most significant one down. Rows
that tie at the boundary are resolved by id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logrung.session import landed

ROWS_PER_BLOCK = 16_384
QUERIES_PER_GROUP = 256
#: Bound of quantised components that are clamped; scores of up to 128 of them fit 64 bits.
LARGEST = 1 << 28
#: Bound of exact ones: the span of a block's column fits a long.
EXACT = 1 << 62

_INDEX = "block int, dims int, lows binary, widths binary, ids binary, slices binary"


def quantised(vector: Column, scale: float, exact: bool = False) -> Column:
    """floor(scale * x) of each component as long, or null if the vector or a component is null or not finite.

    Values beyond 2^28 are clamped to it; with ``exact`` they are kept, and
    one of 2^62 or more is an error.
    """
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    too_large = F.raise_error(F.lit("a scaled component does not fit the index")).cast("long")

    def step(v: Column) -> Column:
        scaled, bound = v * F.lit(float(scale)), float(LARGEST)
        if not exact:
            # Clamped before floor, which would overflow on very large doubles.
            return F.floor(F.least(F.greatest(scaled, F.lit(-bound)), F.lit(bound))).cast("long")
        # Null and non-finite components void the whole vector below and are no error.
        off = v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
        fits = F.abs(scaled) < F.lit(float(EXACT))
        return F.when(off, F.lit(None).cast("long")).when(fits, F.floor(scaled).cast("long")).otherwise(too_large)

    steps = F.transform(x, step)
    return F.when(vector.isNotNull() & finite, steps)


class SlicedBlock:
    """The slices of one block; rows ascend by id."""

    def __init__(self, ids: np.ndarray, lows: np.ndarray, widths: np.ndarray, slices: np.ndarray):
        self.ids, self.lows, self.widths = ids, lows, widths
        self._first = np.concatenate(([0], np.cumsum(widths)))
        # Complements serve negative factors: -x = ~x - (2^w - 1).
        self._slices = np.concatenate((slices, ~slices)) if len(slices) else slices
        self._words = -(-len(ids) // 64)
        bits = np.zeros(self._words * 64, bool)
        bits[: len(ids)] = True
        self._rows = np.packbits(bits, bitorder="little").view(np.uint64)

    @staticmethod
    def build(ids: np.ndarray, values: np.ndarray) -> SlicedBlock:
        """From ids and a matrix of integers, one row for each id."""
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order], values[order]
        lows = values.min(axis=0)
        above = values - lows
        widths = np.array([int(m).bit_length() for m in above.max(axis=0)], np.int64)
        words = -(-len(ids) // 64)
        slices = np.zeros((int(widths.sum()), words * 8), np.uint8)
        at = 0
        for j, width in enumerate(widths):
            for b in range(width):
                packed = np.packbits(((above[:, j] >> b) & 1).astype(bool), bitorder="little")
                slices[at, : len(packed)] = packed
                at += 1
        return SlicedBlock(ids, lows, widths, slices.view(np.uint64))

    def stored(self) -> tuple[bytes, ...]:
        half = self._slices[: len(self._slices) // 2]
        return tuple(x.tobytes() for x in (self.lows, self.widths, self.ids, half))

    @staticmethod
    def read(lows: bytes, widths: bytes, ids: bytes, slices: bytes) -> SlicedBlock:
        ids_ = np.frombuffer(ids, np.int64)
        words = -(-len(ids_) // 64)
        flat = np.frombuffer(slices, np.uint64)
        return SlicedBlock(
            ids_, np.frombuffer(lows, np.int64), np.frombuffer(widths, np.int64), flat.reshape(-1, words)
        )

    def score_slices(self, query: np.ndarray) -> tuple[list[np.ndarray | None], int]:
        """Slices of (score - base) from the least significant one, and base."""
        base = 0
        columns: dict[int, list[int]] = {}
        all_ = int(self._first[-1])
        for j in range(min(len(query), len(self.widths))):
            factor, width = int(query[j]), int(self.widths[j])
            base += factor * int(self.lows[j])
            sign, left, shift = (1 if factor >= 0 else -1), abs(factor), 0
            while left:
                if left & 1:
                    # Signed digits without neighbours: a third of the bits instead of half.
                    digit = 2 - (left & 3)
                    left -= digit
                    first = int(self._first[j])
                    if digit * sign < 0:
                        base -= ((1 << width) - 1) << shift
                        first += all_
                    for b in range(width):
                        columns.setdefault(shift + b, []).append(first + b)
                left >>= 1
                shift += 1
        out: list[np.ndarray | None] = []
        carries: list[np.ndarray] = []
        top = max(columns, default=-1)
        weight = 0
        while weight <= top or carries:
            parts = carries + ([self._slices[columns[weight]]] if weight in columns else [])
            carries = []
            if not parts:
                out.append(None)
                weight += 1
                continue
            now = np.concatenate(parts) if len(parts) > 1 else parts[0]
            while len(now) >= 3:
                third = len(now) // 3
                a, b, c = now[:third], now[third : 2 * third], now[2 * third : 3 * third]
                either = a ^ b
                carries.append((a & b) | (either & c))
                either ^= c
                now = np.concatenate((either, now[3 * third :])) if len(now) > 3 * third else either
            if len(now) == 2:
                carries.append(now[:1] & now[1:])
                now = now[:1] ^ now[1:]
            out.append(now[0])
            weight += 1
        return out, base

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows, ties to smaller ids; rows with the query's id take no part."""
        slices, base = self.score_slices(query)
        tied = self._rows.copy()
        own = np.arange(np.searchsorted(self.ids, query_id), np.searchsorted(self.ids, query_id, "right"))
        for p in own.tolist():
            tied[p >> 6] &= ~(np.uint64(1) << np.uint64(p & 63))
        taken = np.zeros_like(tied)
        n_taken, n_tied = 0, int(np.bitwise_count(tied).sum())
        if n_tied > k:
            for s in reversed(slices):
                if s is None:
                    continue
                high = tied & s
                n_high = int(np.bitwise_count(high).sum())
                if n_taken + n_high >= k:
                    tied, n_tied = high, n_high
                else:
                    taken |= high
                    n_taken += n_high
                    tied = tied & ~s
                    n_tied -= n_high
                if n_taken + n_tied == k:
                    break
        places = [
            np.flatnonzero(np.unpackbits(taken.view(np.uint8), bitorder="little")),
            np.flatnonzero(np.unpackbits(tied.view(np.uint8), bitorder="little"))[: k - n_taken],
        ]
        rows = np.concatenate(places)
        # Python integers: a base or a partial sum may be wider than the score.
        scores = [base] * len(rows)
        word, bit = rows >> 6, (rows & 63).astype(np.uint64)
        for weight, s in enumerate(slices):
            if s is not None:
                ones = ((s[word] >> bit) & np.uint64(1)).tolist()
                scores = [x + (one << weight) for x, one in zip(scores, ones, strict=True)]
        if any(not -(1 << 63) <= x < 1 << 63 for x in scores):
            raise OverflowError(f"a score of query {query_id} does not fit a long")
        return self.ids[rows], np.array(scores, np.int64)


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    lists = vectors.to_pylist()
    out = np.zeros((len(lists), max(map(len, lists), default=0)), np.int64)
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def build_index(vectors: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """The written index of (vec_id, q): one row for each block.

    Rows are dealt to blocks of about ``rows_per_block`` by a hash of their
    row number, so repeated ids or vectors do not pile up in one block.
    """

    def build(rows: pa.Table) -> pa.Table:
        block = SlicedBlock.build(rows["vec_id"].to_numpy(), _matrix(rows["q"]))
        lows, widths, ids, slices = block.stored()
        return pa.table(
            {
                "block": pa.array([rows["block"][0].as_py()], pa.int32()),
                "dims": pa.array([len(block.lows)], pa.int32()),
                "lows": pa.array([lows], pa.binary()),
                "widths": pa.array([widths], pa.binary()),
                "ids": pa.array([ids], pa.binary()),
                "slices": pa.array([slices], pa.binary()),
            }
        )

    numbered = vectors.withColumn("row", F.monotonically_increasing_id())
    blocks = max(1, -(-vectors.count() // rows_per_block))
    dealt = numbered.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).drop("row")
    return landed(dealt.groupBy("block").applyInArrow(build, _INDEX), "bit-sliced-index")


def top_k(queries: DataFrame, index: DataFrame, k: int, per_group: int = QUERIES_PER_GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of the index for each of ``queries`` (vec_id, q).

    Every query meets every block, in groups: a group of queries and a block
    are brought together by an equi-join on their numbers, so a task holds one
    block and at most about ``per_group`` queries. Each pair of group and block
    gives at most k rows for a query, of which the k best stay.
    """
    numbered = landed(queries.withColumn("row", F.monotonically_increasing_id()), "search-queries")
    groups = max(1, -(-numbered.count() // per_group))
    grouped = numbered.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
    count = index.agg(F.coalesce(F.max("block"), F.lit(-1)).alias("last")).first().last
    asked = grouped.select(
        "part", F.explode(F.sequence(F.lit(0), F.lit(max(0, count)))).alias("block"), "vec_id", "q"
    )
    held = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        for row in right.select(["lows", "widths", "ids", "slices"]).to_pylist():
            block = SlicedBlock.read(**row)
            for query_id, q in zip(left["vec_id"].to_pylist(), left["q"].to_pylist(), strict=True):
                ids, scores = block.best(query_id, np.array(q, np.int64), k)
                out += [(query_id, i, s) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)]
        return pa.table(
            {n: pa.array([o[i] for o in out], pa.int64()) for i, n in enumerate(("query_id", "vec_id", "score"))}
        )

    found = (
        asked.groupBy("block", "part")
        .cogroup(held.groupBy("block", "part"))
        .applyInArrow(search, "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def search_table(vectors: DataFrame, is_query: Column, scale: float, k: int, exact: bool = False) -> DataFrame:
    """The k best rows of a table (vec_id, embedding) for each of its rows that ``is_query`` marks.

    Null ids and null vectors, or vectors with null or non-finite components,
    take no part; vectors of unlike length score over their common part. A
    query never finds rows of its own id. Of repeated query ids the smallest
    vector is asked; repeated rows are all candidates. An empty table gives no
    rows.
    """
    usable = landed(
        vectors.select(
            F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale, exact).alias("q")
        ).where("vec_id is not null and q is not null"),
        "quantised",
    )
    queries = usable.where(is_query).groupBy("vec_id").agg(F.min("q").alias("q"))
    return top_k(queries, build_index(usable), k)

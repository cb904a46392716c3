"""Windowed top-k by inner product over a multiway hyperplane tree, and hard negatives from it.

Vectors get one more component that gives all of them the same length M, which
turns inner products into distances: a query q has distance
sqrt(|q|^2 + M^2 - 2 score) to a row, so a window of scores is an annulus around
the query. The tree splits rows by their nearest split point. Every split point
of a node stores, for each subtree of the node, the least and greatest distance
to its rows. A subtree is left out when these ranges, shifted by the query's
distance to the split points, do not meet the annulus; its outer radius shrinks
as better rows are found. Leaves are searched exactly, in integers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logrung.llm.bit_sliced import quantised
from logrung.llm.files import attempt_name, open_for_writing, read_bytes, shared_folder
from logrung.session import landed

#: Rows of a block, which is a subtree built and read as a whole.
ROWS_PER_BLOCK = 16_384
#: Split points above the blocks, at most; the driver draws three times as many rows to choose them from.
MOST_CELLS = 1024
FANOUT = 16
LEAF_ROWS = 256
#: Blocks that one task searches, one after the other.
BLOCKS_PER_STRIPE = 1024
ANCHORS_PER_GROUP = 64
#: Tasks of one search; beyond it a task takes several groups.
MOST_TASKS = 8192

_NONE = np.iinfo(np.int64).min
_LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Space:
    """What all tasks know of the vectors: their width and the square of the common length."""

    dims: int
    square: float

    @property
    def slack(self) -> float:
        """Bound of the rounding error of a distance."""
        return 1e-6 * (1.0 + self.square) ** 0.5

    def lifted(self, values: np.ndarray) -> np.ndarray:
        """Rows with the component that gives them the common length."""
        x = values.astype(np.float64)
        rest = np.sqrt(np.maximum(self.square - (x * x).sum(axis=1), 0.0))
        return np.column_stack((x, rest))

    def radius(self, squares: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The distance at which rows of these scores lie from queries of these squared lengths."""
        return np.sqrt(np.maximum(squares + self.square - 2.0 * scores, 0.0))

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """All inner products, exact: no partial sum is above ``square``, which a double or a long can hold."""
        if self.square < 2.0**52:
            return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
        return a.astype(np.int64) @ b.astype(np.int64).T


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``a`` to those of ``b``."""
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def far_apart(points: np.ndarray, many: int, slack: float) -> np.ndarray:
    """Up to ``many`` of the rows, each the one farthest from those before it; equal rows count once."""
    chosen = [0]
    nearest = distances(points, points[:1])[:, 0]
    while len(chosen) < many:
        far = int(np.argmax(nearest))
        if nearest[far] <= 2 * slack:
            break
        chosen.append(far)
        nearest = np.minimum(nearest, distances(points, points[far : far + 1])[:, 0])
    return np.array(chosen)


@dataclass
class Block:
    """A tree over some rows. Rows of a leaf are consecutive.

    Node i has the split rows ``splits[first[i]:first[i + 1]]`` and, for each
    of them, a child: another node, or leaf ``-1 - child`` with the rows
    ``leaves[leaf]`` to ``leaves[leaf + 1]``. ``low`` and ``high`` hold the
    square matrices of ranges (split point, child) of all nodes, flat. A block
    without a node is one leaf.
    """

    ids: np.ndarray
    labels: np.ndarray
    values: np.ndarray
    splits: np.ndarray
    first: np.ndarray
    children: np.ndarray
    low: np.ndarray
    high: np.ndarray
    leaves: np.ndarray

    @staticmethod
    def build(ids: np.ndarray, labels: np.ndarray, values: np.ndarray, space: Space, fanout: int = FANOUT, leaf_rows: int = LEAF_ROWS) -> Block:
        lifted = space.lifted(values)
        rng = np.random.Generator(np.random.PCG64(len(ids)))
        splits: list[np.ndarray] = []
        children: list[np.ndarray] = []
        low: list[np.ndarray] = []
        high: list[np.ndarray] = []
        leaves: list[np.ndarray] = []
        open_: list[tuple[np.ndarray, int, int]] = [(np.arange(len(ids)), -1, 0)]
        # Depth first, so nodes and leaves are numbered as they are met.
        while open_:
            rows, parent, place = open_.pop()
            chosen = np.zeros(0, np.int64)
            if len(rows) > leaf_rows:
                some = rows[np.sort(rng.choice(len(rows), min(len(rows), 3 * fanout), replace=False))]
                chosen = some[far_apart(lifted[some], fanout, space.slack)]
            if len(chosen) < 2:
                number = -1 - len(leaves)
                leaves.append(rows)
            else:
                number = len(splits)
                away = distances(lifted[rows], lifted[chosen])
                nearest = away.argmin(axis=1)
                parts = [nearest == j for j in range(len(chosen))]
                # A split point may lose its own rows to an equal one; an empty subtree fits no query.
                low.append(np.stack([away[p].min(axis=0, initial=np.inf) for p in parts], axis=1).ravel())
                high.append(np.stack([away[p].max(axis=0, initial=-np.inf) for p in parts], axis=1).ravel())
                splits.append(chosen)
                children.append(np.zeros(len(chosen), np.int64))
                open_ += [(rows[p], number, j) for j, p in reversed(list(enumerate(parts)))]
            if parent >= 0:
                children[parent][place] = number
        order = np.concatenate(leaves)
        moved = np.empty(len(order), np.int64)
        moved[order] = np.arange(len(order))
        largest = int(np.abs(values).max(initial=0))
        kind = np.int16 if largest < 1 << 15 else np.int32 if largest < 1 << 31 else np.int64

        def joined(parts: list[np.ndarray], dtype: type) -> np.ndarray:
            return np.concatenate(parts).astype(dtype) if parts else np.zeros(0, dtype)

        return Block(
            ids[order],
            labels[order],
            values[order].astype(kind),
            moved[joined(splits, np.int64)],
            np.cumsum([0] + [len(s) for s in splits]),
            joined(children, np.int64),
            joined(low, np.float64),
            joined(high, np.float64),
            np.cumsum([0] + [len(x) for x in leaves]),
        )

    def write(self, uri: str) -> None:
        """As one row of an Arrow file."""
        columns = {n: pa.array([getattr(self, n).tobytes()], pa.large_binary()) for n in self.__annotations__}
        columns["kind"] = pa.array([self.values.dtype.str])
        table = pa.table(columns)
        with open_for_writing(uri) as out, pa.ipc.new_file(out, table.schema) as writer:
            writer.write_table(table)

    @staticmethod
    def read(uri: str, dims: int) -> Block:
        """Arrays are views of the file's buffer."""
        row = pa.ipc.open_file(read_bytes(uri)).get_batch(0)
        kinds = {"low": np.float64, "high": np.float64, "values": np.dtype(row.column("kind")[0].as_py())}
        arrays = {
            n: np.frombuffer(row.column(n)[0].as_buffer(), kinds.get(n, np.int64)) for n in Block.__annotations__
        }
        arrays["values"] = arrays["values"].reshape(-1, dims)
        return Block(**arrays)


class Searches:
    """Open searches of one task: k best rows of each, within a window of scores and a condition on labels.

    Search i asks with vector ``of[i]`` for rows of its label (``same``) or of
    other labels, whose id is not its own and whose score is ``least`` to
    ``most``. Higher scores come first, ties by smaller id.
    """

    def __init__(self, space: Space, vectors: np.ndarray, of: np.ndarray, ids: np.ndarray, labels: np.ndarray, same: bool, least: np.ndarray, most: np.ndarray, k: int):
        self.space, self.vectors, self.of = space, vectors, of
        self.ids, self.labels, self.same, self.least, self.most, self.k = ids, labels, same, least, most, k
        lifted = vectors.astype(np.float64)
        self._lifted = np.column_stack((lifted, np.zeros(len(lifted))))
        self._squares = (lifted * lifted).sum(axis=1)[of]
        self.best_scores = np.full((len(of), k), _NONE)
        self.best_ids = np.full((len(of), k), _LAST)
        self._inner = space.radius(self._squares, most.astype(np.float64))
        self.rows_scored = 0

    def to(self, points: np.ndarray) -> np.ndarray:
        """Distances of the vectors to lifted points."""
        return distances(self._lifted, points)

    def meets(self, alive: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which searches may find a row whose distance lies between ``low`` and ``high``."""
        worst = np.maximum(self.best_scores[alive, -1], self.least[alive])
        outer = self.space.radius(self._squares[alive], worst.astype(np.float64))
        near = (low <= outer + self.space.slack) & (high >= self._inner[alive] - self.space.slack)
        return near & (self.least[alive] <= self.most[alive])

    def scan(self, block: Block, begin: int, end: int, alive: np.ndarray) -> None:
        """Compare the rows of a leaf."""
        asked, at = np.unique(self.of[alive], return_inverse=True)
        scores = self.space.scores(self.vectors[asked], block.values[begin:end])[at]
        self.rows_scored += len(asked) * (end - begin)
        ids = block.ids[begin:end]
        fits = (block.labels[begin:end] == self.labels[alive, None]) == self.same
        fits &= ids != self.ids[alive, None]
        fits &= (scores >= np.maximum(self.best_scores[alive, -1], self.least[alive])[:, None]) & (scores <= self.most[alive, None])
        some = fits.any(axis=1)
        alive, fits, scores = alive[some], fits[some], scores[some]
        if not len(alive):
            return
        # Only columns that some search takes are sorted.
        used = fits.any(axis=0)
        fits, scores, ids = fits[:, used], scores[:, used], ids[used]
        all_scores = np.concatenate((self.best_scores[alive], np.where(fits, scores, _NONE)), axis=1)
        all_ids = np.concatenate((self.best_ids[alive], np.where(fits, ids, _LAST)), axis=1)
        first = np.lexsort((all_ids, -(all_scores + 1)), axis=1)[:, : self.k]
        self.best_scores[alive] = np.take_along_axis(all_scores, first, axis=1)
        self.best_ids[alive] = np.take_along_axis(all_ids, first, axis=1)

    def descend(self, block: Block) -> None:
        """Search a block's tree with all open searches."""
        if len(block.first) < 2:
            self.scan(block, 0, len(block.ids), np.arange(len(self.of)))
            return
        open_ = [(0, np.arange(len(self.of)), None, None)]
        while open_:
            child, alive, low, high = open_.pop()
            if low is not None:
                # Once more: what was found since may have closed the annulus.
                alive = alive[self.meets(alive, low, high)]
            if not len(alive):
                continue
            if child < 0:
                self.scan(block, int(block.leaves[-1 - child]), int(block.leaves[-child]), alive)
                continue
            begin, end = int(block.first[child]), int(block.first[child + 1])
            many = end - begin
            ranges = int((np.diff(block.first[: child + 1]) ** 2).sum())
            shape = (many, many)
            lows = block.low[ranges : ranges + many * many].reshape(shape)
            highs = block.high[ranges : ranges + many * many].reshape(shape)
            asked, at = np.unique(self.of[alive], return_inverse=True)
            away = distances(self._lifted[asked], self.space.lifted(block.values[block.splits[begin:end]]))
            least, most = bounds(away, lows, highs)
            # Nearest subtrees last, so that they are taken first.
            for j in np.argsort(-least.min(axis=0), kind="stable").tolist():
                open_.append((int(block.children[begin + j]), alive, least[at, j], most[at, j]))


def bounds(away: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) distance from each query to rows of each subtree.

    ``away`` are distances of queries to split points; row i of ``low`` and
    ``high`` is the range of split point i to each subtree.
    """
    least = np.zeros((len(away), low.shape[1]))
    most = np.full((len(away), low.shape[1]), np.inf)
    for i in range(low.shape[0]):
        d = away[:, i : i + 1]
        np.maximum(least, np.maximum(d - high[i], low[i] - d), out=least)
        np.minimum(most, d + high[i], out=most)
    return least, most


def _matrix(vectors: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy()
    out = np.zeros((len(vectors), dims), np.int64)
    out[np.repeat(np.arange(len(vectors)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


@dataclass
class Index:
    """A written tree: a row for each stripe of blocks, and the split points above them."""

    space: Space
    points: np.ndarray
    stripes: DataFrame
    n_stripes: int


def build_index(
    rows: DataFrame,
    rows_per_block: int = ROWS_PER_BLOCK,
    most_cells: int = MOST_CELLS,
    blocks_per_stripe: int = BLOCKS_PER_STRIPE,
    fanout: int = FANOUT,
    leaf_rows: int = LEAF_ROWS,
) -> Index:
    """Index every row of ``rows`` (row, vec_id, label, q); ``row`` must be unique.

    The split points of the top are chosen among at most 3 * ``most_cells``
    rows, drawn by a hash of the row number. Rows go to the cell of their
    nearest point; a cell of more than ``rows_per_block`` rows is dealt to
    several blocks by a hash, so a hot cell is split. One task builds a block
    and writes it to a file of its own; only files that the written manifest
    names are read.
    """
    spark = rows.sparkSession
    size = rows.agg(
        F.count("*").alias("n"),
        F.coalesce(F.max(F.size("q")), F.lit(0)).alias("dims"),
        F.coalesce(F.max(F.aggregate("q", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))), F.lit(0.0)).alias("square"),
    ).first()
    if size.square >= 2.0**62:
        raise OverflowError("scores of these vectors may not fit a long")
    # A little more than the longest vector, against rounding.
    space = Space(size.dims, size.square * (1 + 1e-12) + 1e-9)
    cells = min(most_cells, max(1, -(-size.n // rows_per_block)))
    drawn = rows.orderBy(F.xxhash64("row"), "row").limit(3 * cells).select("q").toArrow()
    if not drawn.num_rows:
        return Index(space, np.zeros((0, space.dims + 1)), spark.createDataFrame([], "stripe int, path string"), 0)
    points = space.lifted(_matrix(drawn["q"], space.dims))
    points = points[far_apart(points, cells, space.slack)]

    def nearest(batches):
        for batch in batches:
            away = distances(space.lifted(_matrix(batch.column("q"), space.dims)), points)
            yield batch.append_column("cell", pa.array(away.argmin(axis=1).astype(np.int32)))

    columns = rows.select("row", "vec_id", "label", "q")
    placed = landed(
        columns.mapInArrow(nearest, "row long, vec_id long, label long, q array<long>, cell int"), "tree-rows"
    )
    counts = landed(placed.groupBy("cell").agg(F.ceil(F.count("*") / rows_per_block).cast("int").alias("parts")), "tree-cells")
    dealt = placed.join(counts, "cell").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    folder = shared_folder(spark, "tree-blocks")

    def build(table: pa.Table) -> pa.Table:
        values = _matrix(table["q"], space.dims)
        block = Block.build(
            table["vec_id"].to_numpy(), table["label"].to_numpy().astype(np.int64), values, space, fanout, leaf_rows
        )
        cell, part = table["cell"][0].as_py(), table["part"][0].as_py()
        path = attempt_name(folder, f"block-{cell:05d}-{part:06d}", ".arrow")
        block.write(path)
        away = distances(space.lifted(values), points)
        return pa.table(
            {
                "cell": pa.array([cell], pa.int32()),
                "part": pa.array([part], pa.int32()),
                "path": [path],
                "low": pa.array([away.min(axis=0).tolist()], pa.list_(pa.float64())),
                "high": pa.array([away.max(axis=0).tolist()], pa.list_(pa.float64())),
            }
        )

    manifest = landed(
        dealt.groupBy("cell", "part").applyInArrow(build, "cell int, part int, path string, low array<double>, high array<double>"),
        "tree-manifest",
    )
    n_stripes = -(-manifest.count() // blocks_per_stripe)

    def bundle(table: pa.Table) -> pa.Table:
        stripe = table["stripe"][0].as_py()
        path = attempt_name(folder, f"stripe-{stripe:05d}", ".arrow")
        table = table.sort_by([("cell", "ascending"), ("part", "ascending")]).drop_columns(["stripe"])
        with open_for_writing(path) as out, pa.ipc.new_file(out, table.schema) as writer:
            writer.write_table(table)
        return pa.table({"stripe": pa.array([stripe], pa.int32()), "path": [path]})

    striped = manifest.withColumn("stripe", F.pmod(F.xxhash64("cell", "part"), F.lit(n_stripes)).cast("int"))
    stripes = landed(striped.groupBy("stripe").applyInArrow(bundle, "stripe int, path string"), "tree-stripes")
    return Index(space, points, stripes, n_stripes)


_FOUND = "search long, vec_id long, score long"


def window_search(searches: DataFrame, index: Index, k: int, same_label: bool, per_group: int = ANCHORS_PER_GROUP) -> DataFrame:
    """(search, rank, vec_id, score): the k best indexed rows of each of ``searches``.

    ``searches`` has row (of the asking vector), vec_id, label, q, and
    ``windows``, an array of (search, least, most): unique numbers and bounds
    of scores. Rows of the same or of other labels are found, never of the
    asking id.

    The stated searches are dealt to groups of about ``per_group`` vectors by
    a hash, and each group meets each stripe of blocks. A task holds its group,
    the manifest of the stripe and one block at a time, nearest blocks first.
    Of the rows that stripes give, k stay for each search.
    """
    space, points = index.space, index.points

    def run(table: pa.Table) -> pa.Table:
        vectors = _matrix(table["q"], space.dims)
        windows = table["windows"].combine_chunks()
        of = np.repeat(np.arange(len(vectors)), np.diff(windows.offsets.to_numpy()))
        numbers, least, most = (windows.flatten().field(n).to_numpy() for n in ("search", "least", "most"))
        ids, labels = table["vec_id"].to_numpy()[of], table["label"].to_numpy().astype(np.int64)[of]
        open_ = Searches(space, vectors, of, ids, labels, same_label, least, most, k)
        blocks = pa.ipc.open_file(read_bytes(table["path"][0].as_py())).read_all()
        low, high = (np.stack(blocks[c].to_numpy(zero_copy_only=False)).T for c in ("low", "high"))
        near, far = bounds(open_.to(points), low, high)
        paths = blocks["path"].to_pylist()
        everyone = np.arange(len(of))
        for j in np.argsort(near.min(axis=0), kind="stable").tolist():
            if open_.meets(everyone, near[of, j], far[of, j]).any():
                open_.descend(Block.read(paths[j], space.dims))
        at, place = np.nonzero(open_.best_ids != _LAST)
        return pa.table({"search": numbers[at], "vec_id": open_.best_ids[at, place], "score": open_.best_scores[at, place]})

    groups = max(1, -(-searches.count() // per_group))
    asked = (
        searches.select(
            F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("group"),
            F.explode(F.sequence(F.lit(0), F.lit(max(0, index.n_stripes - 1)))).alias("stripe"),
            "vec_id", "label", "q", "windows",
        )
        .join(index.stripes, "stripe")
        .repartition(min(MOST_TASKS, groups * max(1, index.n_stripes)), "group", "stripe")
    )
    found = asked.groupBy("group", "stripe").applyInArrow(run, _FOUND)
    order = Window.partitionBy("search").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("search", "rank", "vec_id", "score")


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    scale: float,
    positives: int = 5,
    negatives: int = 10,
    low_percent: int = 30,
    high_percent: int = 90,
    **index_settings: int,
) -> DataFrame:
    """Hard negatives of the rows of (vec_id, label, embedding) that ``is_anchor`` marks.

    (anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score). The score is the integer inner product of components
    floor(scale * x). An anchor's positives are its ``positives`` best other
    rows of its label; for each, the ``negatives`` best rows of other labels
    whose score is ``low_percent`` to ``high_percent`` of the positive's are
    returned. Fewer if there are no more; a positive of a negative score has
    none. Ties go to the smaller vec_id.

    Rows with a null id, label or vector, or a null or non-finite component,
    take no part. Vectors of unlike length score over their common part.
    Rows that repeat an id are candidates and anchors of their own; "other"
    rows are those of other ids. An empty table gives no rows. Vectors whose
    squared length after scaling is 2^62 or more are an error.
    """
    usable = landed(
        vectors.select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.col("label").cast("long").alias("label"),
            quantised(F.col("embedding"), scale, exact=True).alias("q"),
        )
        .where("vec_id is not null and label is not null and q is not null")
        .withColumn("row", F.monotonically_increasing_id()),
        "anchored-rows",
    )
    index = build_index(usable, **index_settings)
    anchors = usable.where(is_anchor)

    def window(number: Column, least: Column, most: Column) -> Column:
        return F.struct(number.alias("search"), least.alias("least"), most.alias("most"))

    every = F.array(window(F.col("row"), F.lit(-(1 << 62)), F.lit(1 << 62)))
    first = landed(window_search(anchors.withColumn("windows", every), index, positives, True), "positives")
    # score = 100 * whole + rest, so that no product overflows.
    whole, rest = F.expr("(score - pmod(score, 100)) div 100"), F.pmod("score", F.lit(100))

    def share(percent: int, up: int) -> Column:
        return (whole * percent + F.floor((rest * percent + up) / 100)).cast("long")

    numbered = landed(
        first.withColumnsRenamed({"search": "row", "vec_id": "positive_id", "rank": "place"})
        .withColumn("search", F.monotonically_increasing_id())
        .withColumn("least", share(low_percent, 99))
        .withColumn("most", share(high_percent, 0)),
        "windows",
    )
    by_anchor = numbered.groupBy("row").agg(F.collect_list(window(F.col("search"), F.col("least"), F.col("most"))).alias("windows"))
    found = landed(window_search(anchors.join(by_anchor, "row"), index, negatives, False), "negatives")
    ids = anchors.select("row", F.col("vec_id").alias("anchor_id"))
    pairs = numbered.join(ids, "row").select("search", "anchor_id", "positive_id", F.col("score").alias("positive_score"))
    return found.join(pairs, "search").select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )

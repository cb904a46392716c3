"""Leaders of similar messages, found by many tasks whatever the size of a leaf.

The messages of a leaf are ordered by rows, then text. A message is a leader
when no leader before it shares enough tokens with it, place by place; every
message then belongs to the leader that it shares most tokens with. Both are
properties of the set of messages, so neither the number of tasks nor the
bounds below change them.

Leaders are found in rounds: the first open messages of a leaf are settled by
one task, a bounded number at a time, and all messages of the leaf meet the new
leaders in slices. Within a task a message meets only leaders that share one of
its rarer (place, token) keys: of w keys, two messages that share ``need`` have
one in common among their w - need + 1 rarest ones, in any order of keys.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logrung.session import landed

WILDCARD = "<*>"


@dataclass(frozen=True)
class Bounds:
    """Sizes of tasks; results do not depend on them."""

    #: Open messages of a leaf that one task settles in the first round; doubles with each round.
    first_open: int = 16_384
    most_open: int = 262_144
    #: Messages of a leaf that one task compares with the leaders of a round.
    slice_rows: int = 50_000
    #: Pairs of message and leader that a task looks at together.
    pairs: int = 2_000_000
    most_tasks: int = 4096


def needed(width: int, similarity: float) -> int:
    """The least number of equal tokens that makes messages of this width similar."""
    return max(1, next(e for e in range(width + 1) if e / width >= similarity))


def _codes(texts: pa.Array, width: int) -> np.ndarray:
    """A matrix of numbers, equal where texts have the same token at the same place."""
    words = pc.split_pattern(texts, " ").flatten()
    out = np.empty((len(texts), width), np.int64)
    first = 0
    for place in range(width):
        column = words.take(pa.array(np.arange(len(texts)) * width + place)).dictionary_encode()
        out[:, place] = column.indices.to_numpy() + first
        first += len(column.dictionary)
    return out


def _rarest(codes: np.ndarray, order_by: np.ndarray, many: int) -> np.ndarray:
    """The ``many`` keys of each row that come first in the common order of keys."""
    rank = np.empty(len(order_by), np.int64)
    rank[np.argsort(order_by, kind="stable")] = np.arange(len(order_by))
    return np.take_along_axis(codes, np.argsort(rank[codes], axis=1, kind="stable")[:, :many], axis=1)


def elected(texts: pa.Array, similarity: float) -> np.ndarray:
    """Places of the leaders among texts of one width, in their order."""
    width = texts[0].as_py().count(" ") + 1
    need = needed(width, similarity)
    codes = _codes(texts, width)
    times = np.bincount(codes.ravel())
    keys = _rarest(codes, times, width - need + 1)
    leaders: list[int] = []
    postings: dict[int, array] = {}
    for i, (row, own) in enumerate(zip(codes, keys.tolist(), strict=True)):
        shared = [k for k in own if times[k] > 1]
        if any(
            ((codes[np.frombuffer(known, np.int64)] == row).sum(axis=1) >= need).any()
            for k in shared
            if (known := postings.get(k)) is not None
        ):
            continue
        leaders.append(i)
        for k in shared:
            postings.setdefault(k, array("q")).append(i)
    return np.array(leaders, np.int64)


def nearest(
    texts: pa.Array, leaders: pa.Array, stored: np.ndarray, similarity: float, pairs: int
) -> tuple[np.ndarray, np.ndarray]:
    """(place of the leader that shares most tokens, number of them) of each text.

    -1 and 0 where no leader shares enough; the first of equals. Wildcards of
    ``stored`` leaders equal nothing.
    """
    width = texts[0].as_py().count(" ") + 1
    need = needed(width, similarity)
    codes = _codes(pa.concat_arrays([texts, leaders]), width)
    wild = np.zeros((len(leaders), width), bool)
    for i in np.flatnonzero(stored):
        wild[i] = [w == WILDCARD for w in leaders[i].as_py().split(" ")]
    own, known = codes[: len(texts)], codes[len(texts) :].copy()
    many = int(codes.max()) + 1
    times = np.bincount(known[~wild], minlength=many + width)
    # A code of its own for the wildcards of each place, which no text has.
    known[wild] = many + np.nonzero(wild)[1]
    probes = _rarest(own, times, width - need + 1)
    filed = _rarest(known, times, width - need + 1)
    by_key = np.argsort(filed.ravel(), kind="stable")
    leader_of = by_key // filed.shape[1]
    ends = np.cumsum(np.bincount(filed.ravel(), minlength=many + width))
    begins = np.concatenate(([0], ends[:-1]))
    best, equal = np.full(len(texts), -1), np.zeros(len(texts), np.int64)
    met = np.cumsum((ends - begins)[probes].sum(axis=1))
    first = 0
    while first < len(texts):
        before = met[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(met, before + pairs, "right")))
        start, count = begins[probes[first:last]].ravel(), (ends - begins)[probes[first:last]].ravel()
        total = int(count.sum())
        at = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(total)
        row = np.repeat(np.repeat(np.arange(first, last), probes.shape[1]), count)
        lead = leader_of[at]
        for begin in range(0, total, pairs):
            r, n = row[begin : begin + pairs], lead[begin : begin + pairs]
            same = (own[r] == known[n]).sum(axis=1)
            good = same >= need
            r, n, same = r[good], n[good], same[good]
            order = np.lexsort((n, -same, r))
            r, n, same = r[order], n[order], same[order]
            head = np.ones(len(r), bool)
            head[1:] = r[1:] != r[:-1]
            r, n, same = r[head], n[head], same[head]
            better = (same > equal[r]) | ((same == equal[r]) & (n < best[r]))
            best[r[better]], equal[r[better]] = n[better], same[better]
        first = last
    return best, equal


_STATE = "leaf string, slices int, slice int, text string, rows long, leader string, equal int, stored boolean"


def _meet(state: DataFrame, leaders: DataFrame, similarity: float, bounds: Bounds, tasks: int) -> DataFrame:
    """``state`` with the better ones of ``leaders`` (leaf, slices, leader, place, stored); earlier leaders win ties."""

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return left
        right = right.sort_by([("place", "ascending")])
        names = right["leader"].combine_chunks()
        best, equal = nearest(
            left["text"].combine_chunks(), names, right["stored"].to_numpy(), similarity, bounds.pairs
        )
        better = equal > left["equal"].to_numpy()
        at, mask = pa.array(np.maximum(best, 0)), pa.array(better)
        new = {
            "leader": names.take(at),
            "equal": pa.array(equal.astype(np.int32)),
            "stored": right["stored"].combine_chunks().take(at),
        }
        for name, values in new.items():
            column = pc.if_else(mask, values, left[name].combine_chunks())
            left = left.set_column(left.schema.get_field_index(name), name, column)
        return left

    spread = leaders.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    return (
        state.repartition(tasks, "leaf", "slice")
        .groupBy("leaf", "slice")
        .cogroup(spread.repartition(tasks, "leaf", "slice").groupBy("leaf", "slice"))
        .applyInArrow(compare, _STATE)
    )


def with_leaders(
    messages: DataFrame, stored: DataFrame | None, similarity: float, bounds: Bounds
) -> DataFrame:
    """(leaf, text, rows, leader, stored) for the distinct ``messages`` (leaf, text, rows).

    ``stored`` (leaf, text, rows) are leaders from the start, before all
    messages; their wildcards equal nothing.
    """
    leaves = messages.groupBy("leaf").agg(F.count("*").alias("n"))
    size = leaves.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    slices = leaves.select("leaf", F.ceil(F.col("n") / bounds.slice_rows).cast("int").alias("slices"))
    state = messages.join(slices, "leaf").selectExpr(
        "leaf", "slices", "cast(pmod(xxhash64(text), slices) as int) AS slice", "text", "rows",
        "cast(NULL AS string) AS leader", "0 AS equal", "false AS stored",
    )
    tasks = min(bounds.most_tasks, max(1, -(-2 * size.all // bounds.slice_rows)))
    if stored is not None:
        state = _meet_stored(state, stored, similarity, bounds, tasks)
    finished: list[DataFrame] = []
    many, left = bounds.first_open, size.most
    while left > 0:
        open_ = state.where("leader IS NULL")
        first = Window.partitionBy("leaf").orderBy(F.desc("rows"), "text")
        now = open_.withColumn("place", F.row_number().over(first)).where(F.col("place") <= many)
        leaders = landed(
            now.select("leaf", "slices", "text", "place").groupBy("leaf").applyInArrow(
                _elector(similarity), "leaf string, slices int, leader string, place int, stored boolean"
            ),
            "leaders",
        )
        # No leaf has more open messages than this after the round.
        left -= many
        if left > 0:
            busy = leaders.select("leaf").distinct()
            finished.append(state.join(busy, "leaf", "left_anti"))
            state = state.join(busy, "leaf", "left_semi")
            state = landed(_meet(state, leaders, similarity, bounds, tasks), "mining-state")
            if leaders.isEmpty():
                break
        else:
            state = _meet(state, leaders, similarity, bounds, tasks)
        many = min(2 * many, bounds.most_open)
    for part in finished:
        state = state.unionByName(part)
    return state.select("leaf", "text", "rows", "leader", "stored")


def _elector(similarity: float) -> Callable[[pa.Table], pa.Table]:
    def elect(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("place", "ascending")])
        rows = rows.take(pa.array(elected(rows["text"].combine_chunks(), similarity)))
        return pa.table(
            {
                "leaf": rows["leaf"],
                "slices": rows["slices"],
                "leader": rows["text"],
                "place": rows["place"],
                "stored": pa.array(np.zeros(rows.num_rows, bool)),
            }
        )

    return elect


def _meet_stored(state: DataFrame, stored: DataFrame, similarity: float, bounds: Bounds, tasks: int) -> DataFrame:
    """Compare with stored templates, a bounded number of a leaf at a time."""
    order = Window.partitionBy("leaf").orderBy(F.desc("rows"), "text")
    known = landed(
        stored.join(state.groupBy("leaf").agg(F.first("slices").alias("slices")), "leaf")
        .withColumn("place", F.row_number().over(order))
        .select("leaf", "slices", F.col("text").alias("leader"), "place", F.lit(True).alias("stored")),
        "stored-leaders",
    )
    last = known.agg(F.coalesce(F.max("place"), F.lit(0)).alias("n")).first().n
    for after in range(0, last, bounds.most_open):
        part = known.where((F.col("place") > after) & (F.col("place") <= after + bounds.most_open))
        state = landed(_meet(state, part, similarity, bounds, tasks), "mining-state")
    return state


def _shared(text: str, leader: str) -> str:
    """SQL: '1' for each place where a text has its leader's token, '0' elsewhere."""
    return (
        f"array_join(zip_with(split({text}, ' '), split({leader}, ' '), "
        f"(x, y) -> IF(x = y AND y <> '{WILDCARD}', '1', '0')), '')"
    )


def _keep_enough(similarity: float):
    """Decide the members of each leader; rows are sorted by leaf, leader and weight, a leader's in a stream.

    A template begins with all fixed tokens of its leader and loses those that
    a member lacks, as long as enough stay; members that would take more are
    sent back. The last row of a leader, with a null mask, has its places.
    """

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, fixed, need = None, 0, 0
        for batch in batches:
            out: list[tuple[str, str, str | None, bool, str | None]] = []
            for leaf, leader, mask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != (leaf, leader):
                    if own:
                        out.append((*own, None, True, f"{fixed:0{own[1].count(' ') + 1}b}"))
                    own = (leaf, leader)
                    need = needed(len(mask), similarity)
                    fixed = int("".join("0" if w == WILDCARD else "1" for w in leader.split(" ")), 2)
                left = fixed & int(mask, 2)
                # What a template has already costs it nothing.
                good = left == fixed or left.bit_count() >= need
                fixed = left if good else fixed
                out.append((leaf, leader, mask, good, None))
            yield _rows(out)
        if own:
            yield _rows([(*own, None, True, f"{fixed:0{own[1].count(' ') + 1}b}")])

    return decide


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string())
    columns = list(zip(*out, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["leaf", "leader", "mask", "kept", "places"]
    )


def grown_templates(
    messages: DataFrame, stored: DataFrame | None, similarity: float, bounds: Bounds | None = None
) -> DataFrame:
    """(template, messages, rows, is_new) from distinct ``messages`` (leaf, text, rows) and ``stored`` ones.

    Messages join their leader's template as long as enough tokens stay
    fixed; those that would take more start over among themselves, so every
    message belongs to a template that fits it. Stored templates that take
    messages come back with their changed text, ``is_new`` false and without
    their stored counts; others do not come back here.
    """
    bounds = bounds or Bounds()
    found: list[DataFrame] = []
    while True:
        led = with_leaders(messages, stored, similarity, bounds).withColumn("mask", F.expr(_shared("text", "leader")))
        led = landed(led, "led-messages")
        weights = led.groupBy("leaf", "leader", "mask").agg(F.sum("rows").alias("weight"))
        decided = landed(
            weights.repartition("leaf", "leader")
            .sortWithinPartitions("leaf", "leader", F.desc("weight"), F.desc("mask"))
            .select("leaf", "leader", "mask")
            .mapInArrow(_keep_enough(similarity), "leaf string, leader string, mask string, kept boolean, places string"),
            "decided",
        )
        kept = led.join(decided.where("mask IS NOT NULL AND kept").select("leaf", "leader", "mask"), ["leaf", "leader", "mask"])
        counts = kept.groupBy("leaf", "leader").agg(
            F.count("*").alias("messages"), F.sum("rows").alias("rows"), F.first("stored").alias("stored")
        )
        text = F.expr(f"array_join(transform(split(leader, ' '), (w, i) -> IF(substring(places, i + 1, 1) = '1', w, '{WILDCARD}')), ' ')")
        shaped = decided.where("mask IS NULL").select("leaf", "leader", "places").join(counts, ["leaf", "leader"])
        was = F.when(F.col("stored"), F.col("leader")).alias("was")
        found.append(shaped.select(text.alias("template"), "messages", "rows", (~F.col("stored")).alias("is_new"), was))
        if decided.where("NOT kept").isEmpty():
            break
        again = decided.where("NOT kept").select("leaf", "leader", "mask")
        messages = landed(led.join(again, ["leaf", "leader", "mask"], "left_semi").select("leaf", "text", "rows"), "again")
        stored = None
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole

"""N-gram Jaccard join by parity sketches.

Texts become sets of hashed word shingles. Within a band of set sizes the
shingles are dealt to P parts by hash, and the XOR of a part's shingles is the
part's parity. A shingle that only one of two sets holds changes one part, so
the number of parts that differ, and likewise the Hamming distance of two
XOR-hashed bit sketches, is at most the size of the symmetric difference. Sets
of n shingles that reach the threshold differ in at most d(n) shingles, so at
least P - d(n) parts agree. Each set therefore emits d(n) + 1 part keys, the
fullest parts first: in any common order, two sets that agree in that many
parts share one of the emitted keys.

Candidates are exact sets compared once. Groups of thousands of similar texts
are joined by stars and contracted before anything is compared in blocks, so no
group is expanded into all pairs. A bucket of more sets than a block holds, such
as the texts around one shared passage, is given up if its sets do not all link:
they are keyed again, rarest keys first, and meet only where a link leaves them
no rarer key to share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logrung.llm.components import components
from logrung.llm.encode import free_encoders, giving_back
from logrung.llm.words import mix64, shingle_set, text_slices, words_of
from logrung.session import landed

#: Members of a bucket that are compared in one task with as many others.
BLOCK = 512
#: A block's sketches take about as many bytes: the sketches of band b have about 3^b bytes.
BLOCK_BYTES = 4 << 20
#: Keys that a task holds before it sends them.
KEYS_AT_ONCE = 1 << 18
#: Sets of large buckets are keyed again by keys of at most so many of these sets first, then by rising number of sets.
RARE_KEY = 16
#: Keeps these keys apart from the first ones; the low bits, which hold the band, are zero.
_AGAIN = np.uint64(0xA24BAED4963EE400)
_BAND_BITS = 8
_ROUND = np.uint64(0x9FB21C651E98DF25)


@dataclass(frozen=True)
class Threshold:
    """Two sets link when ``den * intersection >= num * union``."""

    num: int
    den: int

    def most_different(self, total: int | np.ndarray):
        """The largest symmetric difference of linked sets whose sizes sum to ``total``."""
        return total * (self.den - self.num) // (self.den + self.num)

    def largest(self, n: int) -> int:
        """The size of the largest set that can link with one of ``n``."""
        return n * self.den // self.num

    def links(self, common: int, total: int) -> bool:
        return self.den * common >= self.num * (total - common)


@dataclass(frozen=True)
class Band:
    """Sets of ``low`` to ``high`` shingles; all linked sets whose smaller one is below the next band meet here."""

    number: int
    low: int
    high: int
    parts: int
    bits: int


def bands_of(n: int, limit: Threshold, ratio: int = 3) -> list[Band]:
    """The one or two bands of a set of ``n`` shingles."""
    found, low, number = [], 1, 0
    while low <= n:
        high = limit.largest(low * ratio - 1)
        if n <= high:
            most = limit.most_different(2 * high)
            # Some parts more than the difference: empty parts then need not be emitted.
            parts = most + most // 6 + 4
            found.append(Band(number, low, high, parts, 64 * (1 + high // 24)))
        low, number = low * ratio, number + 1
    return found


def keys_needed(n: int, band: Band, limit: Threshold) -> int:
    """How many keys a set of ``n`` emits, the first ones in any common order; 0 if it links with its copies only."""
    allowed = int(limit.most_different(n + min(limit.largest(n), band.high)))
    return allowed + 1 if allowed else 0


def part_keys(hashes: np.ndarray, band: Band, limit: Threshold) -> np.ndarray:
    """The emitted keys of a sorted set in a band; the band's number is in the low bits."""
    needed = keys_needed(len(hashes), band, limit)
    return fullest_keys(hashes, band, needed)[0] if needed else np.zeros(0, np.uint64)


def fullest_keys(hashes: np.ndarray, band: Band, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``most`` keys of a sorted set in a band, and the numbers of shingles in their parts.

    Parts are ranges of the hash, so those of a sorted set are runs. The order
    of keys is by shingles in the part, fullest first, then by part; it depends
    on the key alone. Empty parts come last and are emitted only where a set
    has too few others.
    """
    part = ((hashes >> np.uint64(32)) * np.uint64(band.parts)) >> np.uint64(32)
    full, begin, count = np.unique(part, return_index=True, return_counts=True)
    parity = np.zeros(band.parts, np.uint64)
    parity[full] = np.bitwise_xor.reduceat(mix64(hashes * _ROUND), begin)
    held = np.zeros(band.parts, np.int64)
    held[full] = count
    chosen = np.argsort(-held, kind="stable")[:most]
    salt = mix64(np.array([band.number + 1], np.uint64) * _ROUND + chosen.astype(np.uint64))
    keys = mix64(parity[chosen] ^ salt)
    return (keys >> np.uint64(_BAND_BITS) << np.uint64(_BAND_BITS)) | np.uint64(band.number), held[chosen]


def bit_sketch(hashes: np.ndarray, band: Band) -> bytes:
    """The parity of the shingles at each of the band's bits."""
    at = (mix64(hashes ^ _ROUND) >> np.uint64(24)) % np.uint64(band.bits)
    odd = np.bincount(at.astype(np.int64), minlength=band.bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def set_id(hashes: np.ndarray) -> int:
    """A 64-bit id of a sorted set; equal sets have equal ids."""
    place = np.arange(1, len(hashes) + 1, dtype=np.uint64) * _ROUND
    total = np.bitwise_xor.reduce(mix64(hashes + place), keepdims=True)
    return int(mix64(total + np.uint64(len(hashes))).view(np.int64)[0])


def _sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The shingle set of each text, A-Z lower-cased."""
    for first, last in text_slices(texts):
        found = words_of(texts.slice(first, last - first), lower=True)
        for i in range(last - first):
            yield shingle_set(found.hashes[found.bounds[i] : found.bounds[i + 1]], words)


def _with_text(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )


def shingle_nodes(docs: DataFrame, words: int, limit: Threshold) -> DataFrame:
    """(doc_id, n, node, sketches): size, id and bit sketches by band of each row's shingle set.

    node and sketches are null for an empty set; of copies in a batch of rows
    only the first carries sketches.
    """

    @giving_back
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_encoders()
        for batch in batches:
            sizes, ids, sketches = [], [], []
            seen: set[int] = set()
            for s in _sets(batch.column(1), words):
                node = set_id(s) if len(s) else None
                sizes.append(len(s))
                ids.append(node)
                new = node is not None and node not in seen
                seen.add(node)
                sketches.append(
                    [{"band": b.number, "bits": bit_sketch(s, b)} for b in bands_of(len(s), limit)] if new else None
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(sketches, kind)],
                names=["doc_id", "n", "node", "sketches"],
            )

    kind = pa.list_(pa.struct([("band", pa.int32()), ("bits", pa.binary())]))
    schema = "doc_id long, n long, node long, sketches array<struct<band: int, bits: binary>>"
    return _with_text(docs).mapInArrow(number, schema)


def _tied(key: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    """(key, node, hub): the first node of each key has no hub, the others point to it."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    hub = node[np.flatnonzero(first)][np.cumsum(first) - 1]
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), pa.array(node), pa.array(hub, mask=first)],
        names=["key", "node", "hub"],
    )


def part_entries(docs: DataFrame, words: int, limit: Threshold) -> DataFrame:
    """(key, node, hub): a row for each emitted part key, copies in a batch of rows once.

    Sets of one batch (of its parts of about KEYS_AT_ONCE keys) that share a key
    are already tied here: the first one stands for them (hub null) and the
    others point to it (hub set). A key of very many sets thus sends one row
    for each part, not one for each set.
    """

    @giving_back
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_encoders()
        for batch in batches:
            seen: set[int] = set()
            keys, nodes, held = [], [], 0
            for s in _sets(batch.column(0), words):
                if not len(s):
                    continue
                node = set_id(s)
                if node in seen:
                    continue
                seen.add(node)
                for band in bands_of(len(s), limit):
                    own = part_keys(s, band, limit)
                    keys.append(own)
                    nodes.append(np.full(len(own), node, np.int64))
                    held += len(own)
                if held >= KEYS_AT_ONCE:
                    yield _tied(np.concatenate(keys), np.concatenate(nodes))
                    keys, nodes, held = [], [], 0
            if keys:
                yield _tied(np.concatenate(keys), np.concatenate(nodes))

    return _with_text(docs).select("text").mapInArrow(emit, "key long, node long, hub long")


def rarest_entries(bodies: DataFrame, limit: Threshold) -> DataFrame:
    """(key, node, hub) as ``part_entries``, for the sets (node, hashes) given, with the rarest keys first.

    The keys of all parts are counted over these sets. What very many of them
    share comes last in the common order, so a set emits it only if it has too
    little of its own: then it is near the threshold to whatever shares the rest.
    """

    @giving_back
    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in (keys, nodes, helds, needs)], names=["key", "node", "held", "need"]
            )

        keys, nodes, helds, needs, total = [], [], [], [], 0
        for batch in batches:
            for node, body in zip(batch.column("node").to_pylist(), batch.column("hashes"), strict=True):
                s = np.frombuffer(body.as_buffer(), np.uint64)
                for band in bands_of(len(s), limit):
                    need = keys_needed(len(s), band, limit)
                    if not need:
                        continue
                    key, held = fullest_keys(s, band, band.parts)
                    keys.append((key ^ _AGAIN).view(np.int64))
                    nodes.append(np.full(len(key), node, np.int64))
                    helds.append(held.astype(np.int32))
                    needs.append(np.full(len(key), need, np.int32))
                    total += len(key)
                if total >= KEYS_AT_ONCE:
                    yield made()
                    keys, nodes, helds, needs, total = [], [], [], [], 0
        if keys:
            yield made()

    @giving_back
    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _tied(batch.column("key").to_numpy(), batch.column("node").to_numpy())

    rows = landed(bodies.select("node", "hashes").mapInArrow(every, "key long, node long, held int, need int"), "all-keys")
    common = landed(rows.groupBy("key").agg(F.count("*").alias("sets")).where(F.col("sets") > RARE_KEY), "common-keys")
    of_set = Window.partitionBy("node", F.col("key").bitwiseAND((1 << _BAND_BITS) - 1))
    order = of_set.orderBy(F.coalesce("sets", F.lit(0)), F.desc("held"), "key")
    return (
        rows.join(common, "key", "left")
        .withColumn("place", F.row_number().over(order))
        .where("place <= need")
        .select("key", "node")
        .mapInArrow(tie, "key long, node long, hub long")
    )


def bucket_stars(entries: DataFrame) -> DataFrame:
    """(key, hub, node) for the members of every key that two or more sets share.

    One shuffle by key; rows that are tied already are dealt evenly. The rows
    of a key then stream past in order, and each is tied to the first.
    """

    @giving_back
    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_hub = None, 0
        for batch in batches:
            tied = batch.filter(batch.column("hub").is_valid())
            if tied.num_rows:
                yield tied.select(["key", "hub", "node"])
            alone = batch.filter(batch.column("hub").is_null())
            if not alone.num_rows:
                continue
            key, node = alone.column("key").to_numpy(), alone.column("node").to_numpy()
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            hub = node[np.flatnonzero(first)]
            if last_key is not None and key[0] == last_key:
                hub[0] = last_hub
            hubs = hub[np.cumsum(first) - 1]
            last_key, last_hub = key[-1], hubs[-1]
            keep = hubs != node
            if keep.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[keep]), pa.array(hubs[keep]), pa.array(node[keep])],
                    names=["key", "hub", "node"],
                )

    deal = F.when(F.col("hub").isNull(), F.col("key")).otherwise(F.xxhash64("key", "node"))
    return (
        entries.withColumn("deal", deal)
        .repartition("deal")
        .drop("deal")
        .sortWithinPartitions("key", "node")
        .mapInArrow(tie, "key long, hub long, node long")
    )


def set_bodies(docs: DataFrame, nodes: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """(node, hashes): the written sets of ``members`` (node), each from one of its texts."""

    @giving_back
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for first, last in text_slices(texts, 4 << 20):
                part = texts.slice(first, last - first)
                sets = {set_id(s): s.tobytes() for s in _sets(part, words) if len(s)}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(sets), pa.int64()), pa.array(list(sets.values()), pa.binary())],
                    names=["node", "hashes"],
                )

    chosen = nodes.join(members, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    ids = landed(chosen.select(F.col("doc_id").alias("chosen_id")), "chosen-ids")
    some = _with_text(docs).join(ids, F.col("doc_id").eqNullSafe(F.col("chosen_id")), "left_semi")
    raw = landed(some.mapInArrow(build, "node long, hashes binary").join(members, "node", "left_semi"), "bodies")
    # Rows that repeat an id may give a set again, from another task. Only those are grouped with their contents.
    again = landed(raw.groupBy("node").count().where("count > 1").select("node"), "bodies-again")
    if again.isEmpty():
        return raw
    once = raw.join(again, "node", "left_anti")
    return landed(
        once.unionByName(raw.join(again, "node", "left_semi").groupBy("node").agg(F.first("hashes").alias("hashes"))),
        "bodies",
    )


def star_pairs(stars: DataFrame) -> DataFrame:
    """(a, b, band): each member of a bucket with its first one."""
    return stars.select(
        F.least("hub", "node").alias("a"),
        F.greatest("hub", "node").alias("b"),
        F.expr(f"cast(key & {(1 << _BAND_BITS) - 1} as int)").alias("band"),
    )


def near_pairs(pairs: DataFrame, sketches: DataFrame, limit: Threshold) -> DataFrame:
    """(a, b) of the distinct pairs (a, b, band) whose sketches allow a link.

    The distance stands in the filter only: as a column too it would be worked
    out twice, by two Python workers for each task, which Spark then keeps.
    """

    @F.arrow_udf("int")
    def distance(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(
            [
                int(np.bitwise_count(np.frombuffer(p.as_buffer(), np.uint8) ^ np.frombuffer(q.as_buffer(), np.uint8)).sum())
                for p, q in zip(x, y, strict=True)
            ],
            pa.int32(),
        )

    left = sketches.select(F.col("node").alias("a"), "band", F.col("bits").alias("x"), F.col("n").alias("nx"))
    right = sketches.select(F.col("node").alias("b"), "band", F.col("bits").alias("y"), F.col("n").alias("ny"))
    most = F.floor((F.col("nx") + F.col("ny")) * (limit.den - limit.num) / (limit.den + limit.num))
    return (
        pairs.groupBy("a", "b")
        .agg(F.min("band").alias("band"))
        .join(left, ["a", "band"])
        .join(right, ["b", "band"])
        .where(limit.den * F.least("nx", "ny") >= limit.num * F.greatest("nx", "ny"))
        .where(distance("x", "y") <= most)
        .select("a", "b")
    )


def verified(pairs: DataFrame, bodies: DataFrame, limit: Threshold) -> DataFrame:
    """(a, b, linked) for distinct pairs, by their exact sets."""

    @giving_back
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                a = np.frombuffer(x.as_buffer(), np.uint64)
                b = np.frombuffer(y.as_buffer(), np.uint64)
                common = int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))
                linked.append(limit.links(common, len(a) + len(b)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"]
            )

    left = bodies.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = bodies.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(
        check, "a long, b long, linked boolean"
    )


def _forest(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Places of the pairs (p, q), taken in order, that join two trees."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    kept = []
    for at, (x, y) in enumerate(zip(p.tolist(), q.tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            root[x] = y
            kept.append(at)
    return np.array(kept, np.int64)


def _sketch_rows(bits: pa.ChunkedArray) -> np.ndarray:
    """Sketches of one length as rows, a view of the Arrow buffer."""
    column = bits.combine_chunks()
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(column), -1)


def _compare_blocks(limit: Threshold, forests: int):
    """A function of the rows of one (key, block, block) group: its key and the pairs that may link across components.

    Rows of side 2 are pairs (node, label) of nodes that are known not to link.
    All that is held are arrays of a block's size.
    """

    def compare(rows: pa.Table) -> pa.Table:
        failed = rows.filter(pc.equal(rows["side"], 2))
        rows = rows.filter(pc.less(rows["side"], 2))
        none = pa.table({x: pa.array([], pa.int64()) for x in ("key", "a", "b")})
        if not rows.num_rows:
            return none
        side = rows["side"].to_numpy()
        node, label, n = rows["node"].to_numpy(), rows["label"].to_numpy(), rows["n"].to_numpy()
        bits = _sketch_rows(rows["bits"])
        few, many = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        order = np.argsort(node[many], kind="stable")
        many = many[order]
        parts = []
        for i in few.tolist():
            apart = many[label[many] != label[i]]
            total = n[apart] + n[i]
            fits = limit.den * np.minimum(n[apart], n[i]) >= limit.num * np.maximum(n[apart], n[i])
            apart, total = apart[fits], total[fits]
            if not len(apart):
                continue
            distance = np.bitwise_count(bits[apart] ^ bits[i]).sum(axis=1, dtype=np.int64)
            near = distance <= limit.most_different(total)
            parts.append(np.stack((distance[near], np.full(int(near.sum()), i), apart[near])))
        if not parts:
            return none
        distance, i, j = np.concatenate(parts, axis=1)
        if failed.num_rows:
            # Pairs as numbers: the place of the second node among all of the block, after the first's.
            names = np.unique(node)
            x, y = failed["node"].to_numpy(), failed["label"].to_numpy()
            held = np.isin(x, names) & np.isin(y, names)
            known = np.searchsorted(names, x[held]) * len(names) + np.searchsorted(names, y[held])
            code = np.searchsorted(names, node[i]) * len(names) + np.searchsorted(names, node[j])
            new = ~np.isin(code, known)
            distance, i, j = distance[new], i[new], j[new]
        order = np.lexsort((j, i, distance))
        i, j = i[order], j[order]
        kept: list[np.ndarray] = []
        for _ in range(forests):
            if not len(i):
                break
            # Of the pairs of two components only the nearest can be in the forest.
            _, x = np.unique(label[i], return_inverse=True)
            _, y = np.unique(label[j], return_inverse=True)
            first = np.sort(np.unique(x * (int(y.max()) + 1) + y, return_index=True)[1])
            # A spanning forest over components: enough if all its pairs turn out to link.
            tree = first[_forest(label[i[first]], label[j[first]])]
            kept.append(np.stack((node[i[tree]], node[j[tree]])))
            left = np.ones(len(i), bool)
            left[tree] = False
            i, j = i[left], j[left]
        a, b = np.concatenate(kept, axis=1) if kept else np.zeros((2, 0), np.int64)
        return pa.table({"key": pa.repeat(rows["key"][0], len(a)), "a": pa.array(a), "b": pa.array(b)})

    return compare


def block_rows(band: Column) -> Column:
    """Members of a block: at most BLOCK, fewer where long sets have sketches of many bytes."""
    return F.greatest(F.lit(8), F.least(F.lit(BLOCK), F.floor(BLOCK_BYTES / F.pow(F.lit(3.0), band)))).cast("int")


def open_buckets(stars: DataFrame) -> DataFrame:
    """(key, node) of the buckets with three or more members, one bucket of each set of members.

    Two members are a pair that the star has tied already. Similar texts share
    many keys, so most buckets repeat another one; sets of members are told
    apart by their number and two sums of 64-bit hashes.
    """
    members = landed(
        stars.select("key", "node").unionByName(stars.select("key", F.col("hub").alias("node"))).distinct(), "members"
    )
    marked = members.groupBy("key").agg(
        F.count("*").alias("k"),
        F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
    )
    kept = marked.where("k > 2").groupBy("k", "x", "y").agg(F.min("key").alias("key"))
    return members.join(kept.select("key"), "key", "left_semi")


def still_open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The written members (key, node) of buckets in two or more components, each with its label and block numbers.

    Components only grow, so a bucket of one component needs nothing any more.
    """
    labelled = landed(
        members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled"
    )
    counts = labelled.groupBy("key", "label").agg(F.count("*").alias("k"))
    split = (
        counts.groupBy("key")
        .agg(F.max_by("label", F.struct("k", "label")).alias("big"), F.sum("k").alias("all"), F.max("k").alias("most"))
        .where("all > most")
    )
    return landed(
        labelled.join(split, "key")
        .withColumn("band", F.expr(f"cast(key & {(1 << _BAND_BITS) - 1} as int)"))
        .withColumn("rows", block_rows(F.col("band")))
        .withColumn("few", F.ceil((F.col("all") - F.col("most")) / F.col("rows")).cast("int"))
        .withColumn("many", F.ceil(F.col("all") / F.col("rows")).cast("int"))
        .withColumn("own", F.xxhash64("node"))
        .withColumn("i", F.pmod("own", F.col("few")).cast("int"))
        .withColumn("j", F.pmod("own", F.col("many")).cast("int"))
        .select("key", "node", "label", "big", "band", "few", "many", "i", "j"),
        "still-open",
    )


def cross_pairs(open_: DataFrame, sketches: DataFrame, failed: DataFrame, limit: Threshold, forests: int) -> DataFrame:
    """The written (key, a, b) of one bucket, two components, and a sketch distance that allows a link.

    In each bucket of ``still_open`` the members outside its largest component
    are compared with all members, in blocks, by Hamming distance. A bucket
    with any such pair that is not known to fail gives at least one.
    """
    outside = open_.where("label <> big")
    many = open_.select(
        "key", F.explode(F.sequence(F.lit(0), F.col("few") - 1)).alias("i"), "j", "node", "label", "band", F.lit(1).alias("side")
    )
    few = outside.select(
        "key", "i", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("j"), "node", "label", "band", F.lit(0).alias("side")
    )
    rows = few.unionByName(many).join(sketches, ["node", "band"]).select("key", "i", "j", "node", "label", "side", "n", "bits")
    both = failed.unionByName(failed.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Failed pairs go to the one block of a bucket where their nodes meet.
    known = landed(
        outside.select("key", "i", F.col("node").alias("a"))
        .join(both, "a")
        .join(open_.select("key", "j", F.col("node").alias("b")), ["key", "b"])
        .select(
            "key", "i", "j", F.col("a").alias("node"), F.col("b").alias("label"), F.lit(2).alias("side"),
            F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("bits"),
        ),
        "known-apart",
    )
    compare = _compare_blocks(limit, forests)
    return landed(
        rows.unionByName(known).groupBy("key", "i", "j").applyInArrow(compare, "key long, a long, b long"), "crossing"
    )


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _ends(pairs: DataFrame) -> DataFrame:
    """The written nodes of the pairs (a, b)."""
    both = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    return landed(both.distinct(), "ends")


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after the links (a, b), which join components: only labels are joined anew."""
    first = labels.select(F.col("node").alias("a"), F.col("label").alias("x"))
    second = labels.select(F.col("node").alias("b"), F.col("label").alias("y"))
    joined = links.join(first, "a", "left").join(second, "b", "left")
    moved = landed(components(joined.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))), "moved")
    tops = moved.select(F.col("node").alias("label"), F.col("label").alias("top"))
    old = labels.join(tops, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    return landed(old.unionByName(moved.join(labels, "node", "left_anti").select("node", "label")), "labels")


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """(doc_id, n_shingles, component_id, node, label) for each row: components of links with Jaccard >= num / den.

    component_id is the smallest doc_id that links reach, the row's own
    included; where all ids reached are null it is null. Null and empty texts,
    and those without words, have no shingles, link with nothing and are their
    own component. Texts of fewer words than a shingle have one shingle, the
    whole sequence. Copies, also of the same id, share a component. An empty
    table gives no rows. Extra columns of ``docs`` are not read.

    ``node`` is the id of the row's set and ``label`` that of its component,
    both null for an empty set. Sets and shingles are told apart by 64-bit hashes. All comparisons that
    decide are over whole sets.
    """
    limit = Threshold(num, den)
    nodes = landed(shingle_nodes(docs, words, limit), "shingle-nodes")
    stars = landed(bucket_stars(part_entries(docs, words, limit)), "stars")
    in_play = stars.select("node").unionByName(stars.select(F.col("hub").alias("node"))).distinct()
    sketches = landed(
        nodes.where("sketches is not null")
        .join(in_play, "node", "left_semi")
        .groupBy("node")
        .agg(F.first("n").alias("n"), F.first("sketches").alias("sketches"))
        .select("node", "n", F.explode("sketches").alias("s"))
        .select("node", "n", "s.band", "s.bits"),
        "sketches",
    )
    near = landed(near_pairs(star_pairs(stars), sketches, limit), "near")
    bodies = set_bodies(docs, nodes, _ends(near), words)
    judged = landed(verified(near, bodies, limit), "judged")
    labels = landed(components(judged.where("linked")), "labels")
    members = still_open(landed(open_buckets(stars), "open-buckets"), labels)
    large = landed(members.where("many > 1").select("node").distinct(), "large-buckets")
    if not large.isEmpty():
        # A bucket of many blocks would be compared block by block. Its sets meet under rarer keys instead.
        bodies = set_bodies(docs, nodes, large, words)
        stars = landed(bucket_stars(rarest_entries(bodies, limit)), "stars")
        near = near_pairs(star_pairs(stars), sketches, limit).join(judged.select("a", "b"), ["a", "b"], "left_anti")
        more = landed(verified(landed(near, "near"), bodies, limit), "judged")
        judged = judged.unionByName(more)
        labels = relabelled(labels, more.where("linked").select("a", "b"))
        # All links among these sets are in the new buckets; a bucket stays for the sets that were not keyed again.
        mixed = landed(members.join(large, "node", "left_anti").select("key").distinct(), "mixed-buckets")
        kept = members.join(mixed, "key", "left_semi").select("key", "node")
        members = still_open(kept.unionByName(landed(open_buckets(stars), "open-buckets")), labels)
    forests = 1
    # Written step by step: one query of all this would run dozens of stages at once, and the driver hold them.
    while not members.isEmpty():
        failed = judged.where("not linked").select("a", "b")
        crossing = cross_pairs(members, sketches, failed, limit, forests)
        if crossing.isEmpty():
            break
        found = landed(_ordered(crossing).distinct(), "found")
        more = landed(verified(found, set_bodies(docs, nodes, _ends(found), words), limit), "judged")
        judged = judged.unionByName(more)
        labels = relabelled(labels, more.where("linked").select("a", "b"))
        if more.where("not linked").isEmpty():
            # The forest held, so no two components of a bucket are near each other any more.
            break
        # Components only grow and failures stay, so a bucket without a pair has none later.
        members = members.join(crossing.select("key").distinct(), "key", "left_semi")
        members = still_open(members.select("key", "node"), labels)
        forests *= 4
    own = nodes.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("own_id"))
    placed = own.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = placed.groupBy("label").agg(F.min("own_id").alias("component_id"))
    by_node = landed(placed.join(smallest, "label").select("node", "label", "component_id"), "components")
    return nodes.join(by_node, "node", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "node",
        "label",
    )


def one_of_each(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The rows of ``docs`` that stand for their component: the one with the smallest doc_id.

    Texts without words link with nothing, so all their rows stay. Where rows
    repeat an id, the set of the text tells them apart and one row of each set
    stays. Null ids come first. Other columns pass through whatever their names.
    """
    found = landed(jaccard_components(docs, words, num, den), "duplicate-components")
    first = found.where("label is not null").groupBy("label").agg(F.min(F.struct("doc_id", "node")).alias("k"))
    keep = landed(
        first.select("k.doc_id", "k.node").unionByName(found.where("label is null").select("doc_id", "node").distinct()),
        "duplicates-kept",
    )
    again = landed(found.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id"), "ids-again")

    @F.arrow_udf("long")
    def node_of(texts: pa.Array) -> pa.Array:
        return pa.array([set_id(s) if len(s) else None for s in _sets(texts, words)], pa.int64())

    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id")
    )
    kept_ids = keep.select(F.col("doc_id").alias("kept_id"), F.col("node").alias("kept_node"))
    repeated = again.select(F.col("doc_id").alias("again_id"))
    plain = whole.join(kept_ids, F.col("id") == F.col("kept_id"), "left_semi")
    if again.isEmpty():
        return plain.select("row.*")
    odd = (
        whole.join(repeated, F.col("id").eqNullSafe(F.col("again_id")), "left_semi")
        .withColumn("node", node_of(F.col("row.text").cast("string")))
        .join(
            kept_ids,
            F.col("id").eqNullSafe(F.col("kept_id")) & F.col("node").eqNullSafe(F.col("kept_node")),
            "left_semi",
        )
    )
    one = odd.where("node is not null").groupBy("id", "node").agg(F.first("row").alias("row"))
    return (
        plain.join(repeated, F.col("id") == F.col("again_id"), "left_anti")
        .select("row")
        .unionByName(odd.where("node is null").select("row"))
        .unionByName(one.select("row"))
        .select("row.*")
    )

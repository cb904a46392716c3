"""URL filter over a sorted digest array.

Rules (host, path) are kept as 64-bit xxhash keys in ascending order beside
their full strings, in Arrow files that workers map into memory. A url is
probed by binary search for each host suffix and path prefix it may match;
a hit counts only if the stored string is equal, so collisions do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logrung.llm.files import attempt_name, open_for_reading, open_for_writing, shared_folder
from logrung.session import landed

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SHARDS = "path string, rules long, first string, last string, lengths array<int>"
_SHARD_ROW = pa.schema(
    [
        ("path", pa.string()),
        ("rules", pa.int64()),
        ("first", pa.string()),
        ("last", pa.string()),
        ("lengths", pa.list_(pa.int32())),
    ]
)
_RULES = pa.schema([("key", pa.uint64()), ("rule", pa.string()), ("verdict", pa.string())])


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.when(F.instr(url, "://") > 0, host).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(F.instr(url, "://") > 0, path).otherwise(F.lit(""))


def _key(rule: str) -> int:
    return xxhash.xxh64_intdigest(rule.encode())


class DigestShard:
    """One mapped file: keys in order, rules and verdicts beside them."""

    def __init__(self, uri: str):
        with open_for_reading(uri) as source:
            table = pa.ipc.open_file(source).read_all().combine_chunks()
        self.keys = table["key"].chunk(0).to_numpy(zero_copy_only=True) if table.num_rows else np.zeros(0, np.uint64)
        self._rules, self._verdicts = table["rule"], table["verdict"]

    def find(self, keys: np.ndarray, rules: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(found, blocked) for each probed rule string, confirmed by equality."""
        found, blocked = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        at = np.searchsorted(self.keys, keys)
        open_ = np.flatnonzero(at < len(self.keys))
        while len(open_):
            open_ = open_[self.keys[at[open_]] == keys[open_]]
            if not len(open_):
                break
            same = pc.equal(self._rules.take(pa.array(at[open_])), rules.take(pa.array(open_)))
            hit = np.asarray(same)
            found[open_[hit]] = True
            verdicts = np.asarray(pc.equal(self._verdicts.take(pa.array(at[open_[hit]])), "block"))
            blocked[open_[hit]] = verdicts
            # Another rule with the same key may follow.
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < len(self.keys)]
        return found, blocked


def build_digests(rules: DataFrame) -> list[dict]:
    """Write rules (host, path, verdict) as digest shards; returns the list of shards.

    Hosts are lower-cased; a rule given twice blocks if any copy blocks; rules
    with a null part are left out. Keys are range-partitioned and sorted, one
    file for each partition; the driver sees one entry for each file.
    """
    folder = shared_folder(rules.sparkSession, "digests")
    whole = (
        rules.select(
            F.concat(F.translate(F.col("host"), _UPPER, _LOWER), F.col("path")).alias("rule"),
            F.col("verdict").alias("verdict"),
            F.length("path").alias("length"),
        )
        .where("rule is not null and verdict is not null")
        .groupBy("rule", "length")
        .agg(F.max("verdict").alias("verdict"))
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Unsigned order as signed: the top bit is flipped.
            keys = np.array([_key(r) for r in batch.column("rule").to_pylist()], np.uint64) ^ np.uint64(1 << 63)
            yield batch.append_column("sorted", pa.array(keys.view(np.int64)))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        keys = rows["sorted"].to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
        path = attempt_name(folder, f"digests-{TaskContext.get().partitionId():05d}", ".arrow")
        batch = pa.record_batch(
            [pa.array(keys), rows["rule"].combine_chunks(), rows["verdict"].combine_chunks()], schema=_RULES
        )
        with open_for_writing(path) as out, pa.ipc.new_file(out, _RULES) as writer:
            writer.write_batch(batch)
        yield pa.RecordBatch.from_pylist(
            [
                {
                    "path": path,
                    "rules": len(keys),
                    "first": str(keys[0]),
                    "last": str(keys[-1]),
                    "lengths": sorted(set(rows["length"].to_pylist())),
                }
            ],
            schema=_SHARD_ROW,
        )

    keyed = whole.mapInArrow(digest, "rule string, length int, verdict string, sorted long")
    shards = keyed.repartitionByRange("sorted").sortWithinPartitions("sorted", "rule").mapInArrow(write, _SHARDS)
    return [r.asDict() for r in landed(shards, "digest-shards").collect()]


_OPEN: dict[str, DigestShard] = {}


def _shard(path: str) -> DigestShard:
    if path not in _OPEN:
        _OPEN[path] = DigestShard(path)
    return _OPEN[path]


def _probes(host: str, path: str, lengths: list[int]) -> list[tuple[str, int]]:
    """(rule string, host length) of each rule that could fit: host suffixes at dots, path prefixes."""
    out, suffix = [], host
    while suffix:
        out += [(suffix + path[:n], len(suffix)) for n in lengths if n <= len(path)]
        suffix = suffix.partition(".")[2]
    return out


def judge(pages: DataFrame, shards: list[dict], url: str = "url", default: str = "allow") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to rows with a url.

    A rule fits its host and all subdomains if the path starts with the rule's
    path. The longest fitting rule string wins, of equally long ones that with
    the longer host. Where none fits, rule is null and the verdict is
    ``default``: no key of the array was hit. Null urls and urls without
    ``://`` have empty host and path and fit no rule. Row-local, no shuffle.
    Columns named host, path, rule or verdict in ``pages`` are replaced.
    """
    lengths = sorted({n for s in shards for n in s["lengths"]})
    bounds = [(s["path"], int(s["first"]), int(s["last"])) for s in shards]

    @F.pandas_udf("rule string, verdict string")
    def probe(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        rows, rules, hosts_long = [], [], []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            for rule, n in _probes(host, path, lengths):
                rows.append(i)
                rules.append(rule)
                hosts_long.append(n)
        keys = np.array([_key(r) for r in rules], np.uint64)
        texts = pa.array(rules, pa.string())
        found, blocked = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        for path, first, last in bounds:
            here = np.flatnonzero((keys >= np.uint64(first)) & (keys <= np.uint64(last)))
            if len(here):
                found[here], blocked[here] = _shard(path).find(keys[here], texts.take(pa.array(here)))
        best: dict[int, tuple[int, int, str, bool]] = {}
        for p in np.flatnonzero(found).tolist():
            offer = (len(rules[p]), hosts_long[p], rules[p], bool(blocked[p]))
            if rows[p] not in best or offer[:2] > best[rows[p]][:2]:
                best[rows[p]] = offer
        none = (0, 0, None, default == "block")
        picked = [best.get(i, none) for i in range(len(hosts))]
        return pd.DataFrame(
            {"rule": [b[2] for b in picked], "verdict": ["block" if b[3] else "allow" for b in picked]}
        )

    # Computed first, so that a clashing column cannot shadow the url.
    parts = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    judged = parts.withColumn("_judged", probe("host", "path"))
    return judged.withColumns(
        {"rule": F.col("_judged.rule"), "verdict": F.col("_judged.verdict")}
    ).drop("_judged")

"""Token ids in Arrow files of fixed-size-list batches.

Documents are dealt to shards by ascending id. A shard is two Arrow IPC files:

* ``*.tokens.arrow``: batches of ``ids`` (fixed-size list of unsigned integers)
  and ``mask`` (fixed-size list of booleans). The shard's token stream is cut
  into sequences of equal length; only its last sequence is padded, with mask
  false. All batches but the last hold the same number of sequences, so
  sequence i is found by arithmetic and read as a view of the mapped file.
* ``*.docs.arrow``: ``doc_id``, ``start`` (in the shard's stream), ``n_tokens``.

The ids take two bytes each when the vocabulary fits, else four.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logrung.llm.encode import TEXT_AT_ONCE, encoder_of
from logrung.llm.files import attempt_name, open_for_reading, open_for_writing, shared_folder
from logrung.llm.words import text_slices
from logrung.session import landed

SEQUENCE = 2048
SEQUENCES_PER_BATCH = 64

_MANIFEST = "shard int, tokens_path string, docs_path string, n_docs long, n_tokens long"
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class TokenFile:
    """Random access to the sequences of one shard without copies."""

    def __init__(self, uri: str):
        self._source = open_for_reading(uri)
        self._reader = pa.ipc.open_file(self._source)
        self.sequence_length = self._reader.schema.field("ids").type.list_size
        meta = self._reader.schema.metadata
        self.per_batch = int(meta[b"sequences_per_batch"])

    def __len__(self) -> int:
        n = self._reader.num_record_batches
        return 0 if n == 0 else (n - 1) * self.per_batch + self._reader.get_batch(n - 1).num_rows

    def batches(self) -> Iterator[np.ndarray]:
        """The ids of each batch as one flat view."""
        for i in range(self._reader.num_record_batches):
            yield self._reader.get_batch(i).column("ids").values.to_numpy(zero_copy_only=True)

    def ids(self, i: int) -> np.ndarray:
        """The ids of sequence i, a view of the mapped file."""
        lists = self._reader.get_batch(i // self.per_batch).column("ids")
        at = (i % self.per_batch) * self.sequence_length
        return lists.values.slice(at, self.sequence_length).to_numpy(zero_copy_only=True)

    def mask(self, i: int) -> pa.BooleanArray:
        """Which places of sequence i hold a token, an Arrow view of the mapped file."""
        lists = self._reader.get_batch(i // self.per_batch).column("mask")
        at = (i % self.per_batch) * self.sequence_length
        return lists.values.slice(at, self.sequence_length)

    def close(self) -> None:
        self._source.close()


class _ShardWriter:
    def __init__(self, folder: str, shard: int, dtype: np.dtype, length: int, per_batch: int):
        stem = f"shard-{shard:06d}"
        self.tokens_path = attempt_name(folder, stem, ".tokens.arrow")
        self.docs_path = attempt_name(folder, stem, ".docs.arrow")
        self._dtype, self._length, self._batch = dtype, length, length * per_batch
        kind = pa.from_numpy_dtype(dtype)
        self._schema = pa.schema(
            [("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))],
            metadata={"sequences_per_batch": str(per_batch)},
        )
        self._out = open_for_writing(self.tokens_path)
        self._docs_out = open_for_writing(self.docs_path)
        self._tokens = pa.ipc.new_file(self._out, self._schema)
        self._docs = pa.ipc.new_file(self._docs_out, _DOCS)
        self._held: list[np.ndarray] = []
        self._n_held = 0
        self.n_docs = self.n_tokens = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        starts = self.n_tokens + np.cumsum(counts) - counts
        self._docs.write_batch(
            pa.record_batch([doc_ids, pa.array(starts), pa.array(counts)], schema=_DOCS)
        )
        self.n_docs += len(counts)
        self.n_tokens += len(ids)
        self._held.append(ids.astype(self._dtype))
        self._n_held += len(ids)
        if self._n_held >= self._batch:
            flat = np.concatenate(self._held)
            whole = len(flat) // self._batch * self._batch
            for at in range(0, whole, self._batch):
                self._write(flat[at : at + self._batch])
            self._held, self._n_held = [flat[whole:]], len(flat) - whole

    def _write(self, flat: np.ndarray) -> None:
        sequences = -(-len(flat) // self._length)
        ids = np.zeros(sequences * self._length, self._dtype)
        ids[: len(flat)] = flat
        mask = np.arange(len(ids)) < len(flat)
        self._tokens.write_batch(
            pa.record_batch(
                [
                    pa.FixedSizeListArray.from_arrays(pa.array(ids), self._length),
                    pa.FixedSizeListArray.from_arrays(pa.array(mask), self._length),
                ],
                schema=self._schema,
            )
        )

    def close(self) -> None:
        if self._n_held:
            self._write(np.concatenate(self._held))
        for x in (self._tokens, self._out, self._docs, self._docs_out):
            x.close()


def write_tokens(
    docs: DataFrame,
    path: str,
    spaces_kept: bool,
    end_id: int,
    length: int = SEQUENCE,
    per_batch: int = SEQUENCES_PER_BATCH,
    folder: str | None = None,
) -> DataFrame:
    """Write ``doc_id`` and ``text`` as token shards; returns the manifest.

    Manifest: shard, tokens_path, docs_path, n_docs, n_tokens, base (tokens
    in all shards before it). Shards ascend by doc_id, null ids first, equal
    ids by a hash of the text and then the text; repeated rows all stay. A
    null text is empty and has the end id alone. An empty table has no shard.
    The rows move once, by ranges of (doc_id, hash), so one id that many rows
    repeat is split. A shard is written by one task, batch by batch.
    """
    spark = docs.sparkSession
    where = folder or shared_folder(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, spaces_kept)
        dtype = np.dtype(np.uint16 if max(encoder.n_ids, end_id + 1) <= 1 << 16 else np.uint32)
        shard, out = TaskContext.get().partitionId(), None
        for batch in batches:
            for first, last in text_slices(batch.column(1), TEXT_AT_ONCE):
                ids, counts = encoder.encode(batch.column(1).slice(first, last - first))
                ids = np.insert(ids, np.cumsum(counts), end_id)
                out = out or _ShardWriter(where, shard, dtype, length, per_batch)
                out.add(batch.column(0).slice(first, last - first), ids, counts + 1)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([shard], pa.int32()),
                    "tokens_path": [out.tokens_path],
                    "docs_path": [out.docs_path],
                    "n_docs": pa.array([out.n_docs], pa.int64()),
                    "n_tokens": pa.array([out.n_tokens], pa.int64()),
                }
            )

    mark = F.xxhash64("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange("doc_id", mark).sortWithinPartitions("doc_id", mark, "text")
    manifest = landed(dealt.mapInArrow(write, _MANIFEST), "token-manifest")
    # One row for each shard, not for each document.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


def _documents_of(tokens_path: str, docs_path: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of the document index with the checksum of each document's ids."""
    shard = TokenFile(tokens_path)
    views = shard.batches()
    view, at = np.zeros(0, np.uint32), 0
    with open_for_reading(docs_path) as source:
        reader = pa.ipc.open_file(source)
        for i in range(reader.num_record_batches):
            index = reader.get_batch(i)
            sums = np.zeros(index.num_rows, np.int64)
            for k, left in enumerate(index.column("n_tokens").to_numpy()):
                crc = 0
                while left > 0:
                    if at == len(view):
                        view, at = next(views).astype("<u4"), 0
                    took = min(left, len(view) - at)
                    crc = zlib.crc32(view[at : at + took], crc)
                    at, left = at + took, left - took
                sums[k] = crc
            yield index, sums
    shard.close()


def read_documents(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards' files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for index, sums in _documents_of(row["tokens_path"], row["docs_path"]):
                    yield pa.RecordBatch.from_arrays(
                        [
                            index.column("doc_id"),
                            pa.array(index.column("start").to_numpy() + row["base"]),
                            index.column("n_tokens"),
                            pa.array(sums),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    shards = max(1, manifest.count())
    return (
        manifest.select("shard", "tokens_path", "docs_path", "base")
        .repartition(shards, "shard")
        .mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )

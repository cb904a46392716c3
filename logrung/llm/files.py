"""Files below the shared folder, as Spark tasks and the driver see them."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession

from logrung.session import scratch_path


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the session's shared folder; tasks create it on first use."""
    return scratch_path(spark, label)


def attempt_name(folder: str, stem: str, suffix: str) -> str:
    """A file name that no other attempt of the same task uses.

    Only names that a committed manifest lists are read, so a file left by a
    lost or speculative attempt is never seen.
    """
    return f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"


def _resolved(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def open_for_writing(uri: str):
    """An output stream; parent folders are made where the store has folders."""
    store, path = _resolved(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(path)


def open_for_reading(uri: str) -> pa.NativeFile:
    """A random-access file; local and mounted stores are memory-mapped."""
    store, path = _resolved(uri)
    if isinstance(store, fs.LocalFileSystem):
        return pa.memory_map(path, "r")
    return store.open_input_file(path)


def read_bytes(uri: str) -> pa.Buffer:
    """The whole file as one buffer: a view of the mapping on local and mounted stores."""
    with open_for_reading(uri) as source:
        return source.read_buffer()

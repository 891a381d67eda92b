"""Whole binary files written by tasks into the shared folder, and read back, through Arrow's file systems."""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI (file://, hdfs://, s3://, gs://) or of a plain path."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def read_range(uri: str, start: int = 0, length: int | None = None) -> bytes:
    store, path = open_fs(uri)
    with store.open_input_file(path) as f:
        f.seek(start)
        return f.read() if length is None else f.read(length)


class Writer:
    """A file that is written under a name of its own and moved when it is whole: readers never see part of it, and a
    retried task may repeat it. Nothing is made before the first bytes."""

    def __init__(self, uri: str):
        self.store, self.path = open_fs(uri)
        self.part, self.size, self.out = f"{self.path}.{uuid.uuid4().hex}.tmp", 0, None

    def write(self, chunk: bytes) -> int:
        """Where the bytes begin in the file."""
        if self.out is None:
            self.store.create_dir(os.path.dirname(self.path), recursive=True)
            self.out = self.store.open_output_stream(self.part)
        self.out.write(chunk)
        self.size += len(chunk)
        return self.size - len(chunk)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.store.move(self.part, self.path)


def write_whole(uri: str, chunks: Iterable[bytes]) -> int:
    """Write under a name of its own, then move: readers never see part of a file, and a retried task may repeat it."""
    store, path = open_fs(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part, size = f"{path}.{uuid.uuid4().hex}.tmp", 0
    with store.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    store.move(part, path)
    return size


def write_parts(
    df: DataFrame,
    folder: str,
    suffix: str,
    encode: Callable[[Iterator[pa.RecordBatch], dict], Iterator[bytes]],
) -> list[dict]:
    """One file for each non-empty partition of ``df``; returns their index in partition order.

    ``encode(batches, facts)`` yields the bytes and leaves integers in ``facts`` (``rows`` and ``units``). The name
    depends only on the partition, so a task that runs again replaces its own file. The index has a row a file.
    """

    def write(batches):
        k, batches = TaskContext.get().partitionId(), iter(batches)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        facts = {"rows": 0, "units": 0}
        path = f"{folder}/part-{k:06d}{suffix}"
        size = write_whole(path, encode((b for part in ([first], batches) for b in part if b.num_rows), facts))
        yield pa.RecordBatch.from_pylist([{"part": k, "path": path, "bytes": size, **facts}], schema=INDEX)

    return sorted(
        (r.asDict() for r in df.mapInArrow(write, "part int, path string, bytes long, rows long, units long").collect()),
        key=lambda r: r["part"],
    )


def pack(**arrays: np.ndarray) -> bytes:
    """Named arrays as compressed bytes."""
    head = json.dumps([[k, v.dtype.str, v.size] for k, v in arrays.items()]).encode()
    return zstandard.compress(struct.pack("<I", len(head)) + head + b"".join(v.tobytes() for v in arrays.values()), 1)


def unpack(data: bytes) -> dict[str, np.ndarray]:
    data = zstandard.decompress(data)
    at = 4 + struct.unpack_from("<I", data)[0]
    out = {}
    for name, kind, size in json.loads(data[4:at]):
        out[name] = np.frombuffer(data, kind, size, at)
        at += out[name].nbytes
    return out


INDEX = pa.schema([("part", pa.int32()), ("path", pa.string()), ("bytes", pa.int64()), ("rows", pa.int64()), ("units", pa.int64())])

"""NumPy archives as a Spark data source: ``spark.read.format("npz")`` and ``df.write.format("npz")``.

Reading: a row an archive. The schema names the arrays wanted (numbers, strings, arrays or arrays of arrays of them); of an
archive only its directory and these members are read. ``path`` is the archive's path, and ``failure``, where the schema has
it, says why a row is empty; without it a bad archive fails the job. Members that an archive lacks are null. Archives are
put together in partitions of ``maxPartitionBytes`` (option, 64 MB).

Writing: a row an archive, named by the column of the option ``name`` (default ``name``), which is not stored; null values are
left out. Tasks write into a temporary folder, and the job's commit moves what its successful tasks reported, so that
repeated and failed tasks leave nothing behind.
"""

from __future__ import annotations

import io
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from .shared import _store

EXTRA = ("path", "failure")


def _paths(root: str) -> tuple[fs.FileSystem, list[tuple[str, int]]]:
    """Archives below a folder, or the one file, with their sizes, in the order of their names."""
    store, base = _store(root)
    info = store.get_file_info(base)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=False))
    # What stands in a folder with a leading underscore is not part of the data.
    hidden = lambda p: any(x.startswith("_") for x in posixpath.relpath(p, base).split("/"))
    return store, sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".npz") and (f.path == base or not hidden(f.path)))


def read_members(file, wanted: list[str]) -> dict[str, np.ndarray]:
    """The wanted arrays of an archive that it has, by its directory (names in any case); nothing else is read."""
    out = {}
    with zipfile.ZipFile(file) as z:
        known = {n.removesuffix(".npy").lower(): n for n in z.namelist()}
        for name in wanted:
            if name.lower() in known:
                with z.open(known[name.lower()]) as member:
                    out[name] = np.lib.format.read_array(member, allow_pickle=False)
                    member.read()  # to the end, where the member's checksum is compared
    return out


def _value(array: np.ndarray | None, kind: T.DataType):
    """An array as a value of the type; a single number may stand in an array of one."""
    if array is None:
        return None
    depth, inner = 0, kind
    while isinstance(inner, T.ArrayType):
        depth, inner = depth + 1, inner.elementType
    if depth == 0 and array.size == 1:
        array = array.reshape(())
    if array.ndim != depth:
        raise ValueError(f"an array of {array.ndim} dimensions is no {kind.simpleString()}")
    if isinstance(inner, T.StringType):
        array = array.astype(str)
    elif isinstance(inner, T.BooleanType):
        array = array.astype(bool)
    elif isinstance(inner, (T.DoubleType, T.FloatType)):
        array = array.astype(float)
    else:
        whole = array.astype(np.int64)
        if not np.array_equal(whole, array):
            raise ValueError(f"values are no {kind.simpleString()}")
        array = whole
    return array.tolist()


@dataclass
class Archives(InputPartition):
    paths: list[str]


class NpzReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self) -> list[Archives]:
        most = int(self.options.get("maxPartitionBytes", 64 << 20))
        out, size = [], most
        for path, n in _paths(self.options["path"])[1]:
            if size + n > most and (not out or size):
                out.append(Archives([]))
                size = 0
            out[-1].paths.append(path)
            size += n
        return out or [Archives([])]

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.options["path"])
        kinds = {f.name: f.dataType for f in self.schema if f.name not in EXTRA}
        arrow = to_arrow_schema(self.schema)
        for path in partition.paths:
            row = dict.fromkeys(self.schema.names)
            try:
                with store.open_input_file(path) as f:
                    found = read_members(f, list(kinds))
                row |= {name: _value(found.get(name), kind) for name, kind in kinds.items()}
            except (ValueError, OSError, KeyError, zipfile.BadZipFile) as e:
                if "failure" not in row:
                    raise
                row["failure"] = f"{type(e).__name__}: {e}"
            if "path" in row:
                row["path"] = path
            yield pa.RecordBatch.from_pylist([row], schema=arrow)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class NpzWriter(DataSourceWriter):
    def __init__(self, schema: T.StructType, options: dict, overwrite: bool):
        self.schema, self.options, self.overwrite = schema, options, overwrite
        self.root = options["path"].rstrip("/")
        self.temporary = f"_temporary-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        store, base = _store(self.root)
        name, files = self.options.get("name", "name"), []
        folder = f"{base}/{self.temporary}/{uuid.uuid4().hex}"
        for row in rows:
            values = row.asDict(recursive=True)
            file = str(values.pop(name))
            if not re.fullmatch(r"[A-Za-z0-9._-]+", file) or file.startswith(("_", ".")):
                raise ValueError(f"{file!r} cannot name a file")
            data = io.BytesIO()
            np.savez(data, **{k: np.array(v) for k, v in values.items() if v is not None})
            store.create_dir(folder, recursive=True)
            with store.open_output_stream(f"{folder}/{file}.npz") as out:
                out.write(data.getbuffer())
            files.append((f"{folder}/{file}.npz", f"{file}.npz"))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = _store(self.root)
        files = [f for m in messages if m for f in m.files]
        names = [n for _, n in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows have one name")
        store.create_dir(base, recursive=True)
        if self.overwrite:
            for path, _ in _paths(self.root)[1]:
                store.delete_file(path)
        for path, name in files:
            store.move(path, f"{base}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing but the temporary folder was touched."""
        store, base = _store(self.root)
        if store.get_file_info(f"{base}/{self.temporary}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{self.temporary}")


class NpzSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return "path string, patient_id string, fs double, abp array<double>, failure string"

    def reader(self, schema: T.StructType) -> NpzReader:
        return NpzReader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> NpzWriter:
        return NpzWriter(schema, dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make ``format("npz")`` known to the session."""
    spark.dataSource.register(NpzSource)

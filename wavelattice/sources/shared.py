"""The folder that all executors share: staged tables, and matrices of numbers that tasks read by row number."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}

#: Bytes of a matrix that a worker keeps; of a larger one it reads the parts it needs, one at a time.
HELD = 256 << 20


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; where that is unset, on a local master (tests), in one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        root = _own.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="wavelattice-")
        _own[app] = root
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str = "rows") -> DataFrame:
    """``df`` written as Parquet and read back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with each row's number in an order of all rows, from 0."""
    laid = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "laid")
    laid = laid.withColumn("_part", F.shiftright("_at", 33))
    # A row a part.
    sizes = laid.groupBy("_part").agg(F.count("*").alias("_n"))
    firsts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_first"))
    return laid.join(F.broadcast(firsts), "_part").withColumn(name, F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).select(*df.columns, name)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


_kept: dict[str, np.ndarray] = {}


@dataclass(frozen=True)
class Matrix:
    """Rows of ``width`` numbers in files of consecutive rows: (first row, rows, path), in order."""

    parts: tuple[tuple[int, int, str], ...]
    width: int

    @property
    def rows(self) -> int:
        return self.parts[-1][0] + self.parts[-1][1] if self.parts else 0

    def _part(self, k: int, start: int, stop: int) -> np.ndarray:
        first, _, path = self.parts[k]
        store, path = _store(path)
        size = 8 * self.width
        with store.open_input_file(path) as f:
            f.seek((start - first) * size)
            return np.frombuffer(f.read((stop - start) * size), np.float64).reshape(-1, self.width)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Rows from ``start`` up to ``stop``."""
        if 8 * self.width * self.rows <= HELD:
            return self._all()[start:stop]
        got = [self._part(k, max(start, first), min(stop, first + n)) for k, (first, n, _) in enumerate(self.parts) if first < stop and start < first + n]
        return np.concatenate(got) if got else np.empty((0, self.width))

    def take(self, rows: np.ndarray) -> np.ndarray:
        """The rows of these numbers, in their order; a matrix too large to keep is read part by part."""
        if 8 * self.width * self.rows <= HELD:
            return self._all()[rows]
        out = np.empty((*rows.shape, self.width))
        for k, (first, n, _) in enumerate(self.parts):
            here = (rows >= first) & (rows < first + n)
            if here.any():
                out[here] = self._part(k, first, first + n)[rows[here] - first]
        return out

    def _all(self) -> np.ndarray:
        name = self.parts[0][2] if self.parts else ""
        if name not in _kept:
            # Beside a large matrix, small ones are kept as well.
            while _kept and sum(m.nbytes for m in _kept.values()) + 8 * self.width * self.rows > HELD * 5 // 4:
                _kept.pop(next(iter(_kept)))
            _kept[name] = np.concatenate([self._part(k, first, first + n) for k, (first, n, _) in enumerate(self.parts)]) if self.parts else np.empty((0, self.width))
        return _kept[name]


_INDEX = pa.schema([("part", pa.int32()), ("rows", pa.int64()), ("path", pa.string()), ("width", pa.int32())])


def write_matrix(df: DataFrame, order: list[str], values: list[str]) -> Matrix:
    """The numbers of ``values`` (numbers, or arrays of equally many) in the order of ``order``, a file a task.

    The driver gets a row a file. A file goes by its task's number and is moved when it is whole, so that a task that
    runs again replaces its own.
    """
    folder = scratch(df.sparkSession, "matrix")

    def write(batches: Iterator[pa.RecordBatch]):
        part, rows, width, out = TaskContext.get().partitionId(), 0, 0, None
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        path, temporary = f"{base}/part-{part:06d}.f64", f"{base}/{uuid.uuid4().hex}.tmp"
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = []
            for c in batch.columns:
                flat = (c.flatten() if pa.types.is_list(c.type) else c).to_numpy(zero_copy_only=False).astype(np.float64)
                columns.append(flat.reshape(batch.num_rows, -1))
            block = np.concatenate(columns, axis=1)
            out = out or store.open_output_stream(temporary)
            out.write(np.ascontiguousarray(block).tobytes())
            rows, width = rows + batch.num_rows, block.shape[1]
        if out:
            out.close()
            store.move(temporary, path)
            yield pa.RecordBatch.from_pylist([{"part": part, "rows": rows, "path": f"{folder}/{os.path.basename(path)}", "width": width}], schema=_INDEX)

    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).select(*(F.col(v) for v in values))
    found = sorted(dealt.mapInArrow(write, "part int, rows long, path string, width int").collect())
    parts, at = [], 0
    for r in found:
        parts.append((at, r.rows, r.path))
        at += r.rows
    return Matrix(tuple(parts), found[0].width if found else 0)

"""Scratch folders, batch iteration and skew helpers that the corpus operators have in common."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a table that is sent to every task are kept at or below this number by construction.
MAX_HOT_KEYS = 1000

#: Measured bytes of a table that is sent to every task, at most; beyond it, tables are joined by a shuffle.
MOST_BROADCAST = 8 << 20

#: Rows of an Arrow batch between Spark and Python: whole texts make them heavy.
ARROW_ROWS = 1000

_own_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a local one where none is set on a local master (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        _own_roots[app] = "file://" + tempfile.mkdtemp(prefix="wavelattice-")
        spark.sparkContext.setCheckpointDir(_own_roots[app])
    return _own_roots[app]


def light_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small in this session, where they would be larger."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, *, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def located(df: DataFrame) -> DataFrame:
    """``df`` with ``_file`` and ``_line``, hash of the file and number of the row that each row was read from.

    A row's place does not depend on how files are split among tasks. What was not read from Parquet is staged first.
    """
    place = (F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_line"))
    try:
        return df.select("*", *place)
    except AnalysisException:
        return staged(df, "rows").select("*", *place)


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def byte_slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows whose sizes add up to at most ``most`` (a larger row is a run of its own)."""
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < ends.size:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield start, stop
        start = stop


def lengths_of(column: pa.Array) -> np.ndarray:
    """Bytes of each value of a string or binary column (null: 0)."""
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)


def text_batches(
    batches: Iterable[pa.RecordBatch], column: str, max_chars: int = 1_000_000
) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of Arrow batches with the text column as Python strings (null: empty), of bounded total length.

    Slices are cut by the texts' bytes before any string is made; a text that is longer is a slice of its own.
    """
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        for start, stop in byte_slices(lengths_of(values), max_chars):
            yield batch.slice(start, stop - start), ["" if t is None else t for t in values.slice(start, stop - start).to_pylist()]


def lookup_hot(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Left-join ``left`` to ``right`` (unique in ``key``; ``weight``: the key's number of left rows), safe for hot keys.

    Keys that hold at least a thousandth of ``total`` rows (so at most ``MAX_HOT_KEYS`` of them) are resolved by a
    broadcast of just those rows; all others by a shuffle join in which no key is large. Rows with a null key stay,
    unmatched. ``right`` should be staged, as it is read twice.
    """
    floor = max(100, -(-total // MAX_HOT_KEYS))
    hot = right.where(F.col(weight) >= floor)
    rest = right.where(F.col(weight) < floor)
    marked = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    done = marked.where(F.col("_hot") | F.col(key).isNull()).drop("_hot")
    cold = marked.where(F.col("_hot").isNull() & F.col(key).isNotNull()).select(*left.columns)
    return done.unionByName(cold.join(rest, key, "left"))


def fresh(taken: list[str], name: str) -> str:
    """``name``, with as many underscores behind it as no column has."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def whole(columns: list[str]) -> Column:
    """Columns as one struct ``_doc``, so that no name of theirs meets one of an operator's own; ``_doc.*`` unpacks it."""
    return F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_doc")


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def data_bytes(df: DataFrame) -> int:
    """Bytes of the data of a table, summed over its values (8 for a number)."""

    def width(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)).cast("long") + 8
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.aggregate(c, F.lit(8).cast("long"), lambda total, x: total + width(x, kind.elementType)), F.lit(8).cast("long"))
        if isinstance(kind, T.StructType):
            return sum((width(c.getField(f.name), f.dataType) for f in kind), F.lit(0).cast("long"))
        return F.lit(8).cast("long")

    return df.agg(F.sum(sum((width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(0).cast("long")))).first()[0] or 0


def sized_broadcast(df: DataFrame) -> DataFrame:
    """``df`` (a staged table) marked for broadcast while its measured bytes are at most ``MOST_BROADCAST``."""
    return F.broadcast(df) if data_bytes(df) <= MOST_BROADCAST else df


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str) -> DataFrame:
    """Left-join ``left`` to ``right`` (staged; unique in ``key``; ``weight``: the key's number of left rows), which is
    broadcast while it is small; beyond that only its hot keys are."""
    if data_bytes(right) <= MOST_BROADCAST:
        return left.join(F.broadcast(right), key, "left")
    return lookup_hot(left, right, key, weight, right.agg(F.sum(weight)).first()[0] or 0)

"""Product codes of integer vectors; each part's nearest codebook entry is found through a VA-file.

A codebook's entries are quantised coordinate by coordinate into 2 ** ``BITS`` cells. For a query, one table a coordinate
gives the least and the greatest squared distance to every cell; their sums bound the distance to each entry. Only entries
whose lower bound does not pass the least upper bound are compared, with exact integer distances.

Every round is one pass over the vectors: tasks return sums by part, entry and position, at most one a task, and only the
codebooks, whose size is fixed by parts, entries and length, reach the driver.

Odd inputs: rows whose vector is null or holds null or non-finite components go, as do those with a component of 32,768 or
more in magnitude, whose squared distances would not fit a long, and those of another length than most have (of ties the
longer). Vectors that eight parts do not divide end in zeros. Fewer than sixteen rows make smaller codebooks; ties of an id
go by the vector, null ids come last. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lookup, staged

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BITS = 4  # of a cell's number, for each coordinate
MOST = 1 << 27  # least magnitude of an integer that goes
ROWS = 4096  # vectors compared at a time


class VaFile:
    """The entries of one part (a matrix of integers), with the cells of their coordinates."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        low = entries.min(axis=0)
        width = (entries.max(axis=0) - low) // (1 << bits) + 1
        self.cells = (entries - low) // width
        self.first = low + np.arange(1 << bits)[:, None] * width
        self.last = self.first + width - 1

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances, a row a query and a column an entry."""
        lower = np.zeros((len(queries), len(self.entries)), np.int64)
        upper = np.zeros_like(lower)
        for k in range(self.entries.shape[1]):
            before, behind = self.first[:, k] - queries[:, k, None], queries[:, k, None] - self.last[:, k]
            gap, reach = np.maximum(np.maximum(before, behind), 0), np.maximum(np.abs(before), np.abs(behind))
            lower += (gap * gap)[:, self.cells[:, k]]
            upper += (reach * reach)[:, self.cells[:, k]]
        return lower, upper

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of each query's nearest entry (of ties the first), and how many were compared."""
        lower, upper = self.bounds(queries)
        row, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])
        off = queries[row] - self.entries[entry]
        exact = np.full(lower.shape, np.iinfo(np.int64).max)
        exact[row, entry] = (off * off).sum(axis=1)
        best = exact.argmin(axis=1)
        return best, exact[np.arange(len(queries)), best], row.size


def integers(df: DataFrame, ident: str, vector: str, keep: list[str] | None = None, scale: int = SCALE) -> DataFrame:
    """``_id, _v`` and the columns ``keep`` as ``_doc``: the rows that stay, their vectors as integers, staged."""
    x = F.col(vector)
    fine = F.forall(x, lambda c: F.coalesce(F.abs(c) < float(MOST // scale), F.lit(False)))
    made = df.where(x.isNotNull() & fine).select(
        F.col(ident).cast("long").alias("_id"),
        F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("_v"),
        F.struct(*(F.col(f"`{c}`") for c in keep or []), F.lit(True).alias("_kept")).alias("_doc"),
    )
    made = staged(made, "integers")
    most = made.groupBy(F.size("_v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return made.where(F.size("_v") == (most.n if most else 0))


def _parts(flat: np.ndarray, rows: int, parts: int) -> np.ndarray:
    """Part, row, position; vectors are filled up with zeros."""
    m = flat.reshape(rows, -1)
    m = np.pad(m, ((0, 0), (0, -m.shape[1] % parts)))
    return np.ascontiguousarray(m.reshape(rows, parts, -1).transpose(1, 0, 2))


def _vectors(batch: pa.RecordBatch, parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for start in range(0, batch.num_rows, ROWS):
        piece = batch.slice(start, ROWS)
        flat = piece.column(piece.schema.get_field_index("_v")).flatten().to_numpy(zero_copy_only=False)
        yield piece, _parts(flat.astype(np.int64), piece.num_rows, parts)


def train(made: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, position) of ``integers``: from the first entries' vectors, ``rounds`` times the floor of the mean."""
    first = made.orderBy(F.col("_id").asc_nulls_last(), "_v").select("_v").limit(entries).collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    books = _parts(np.array([r[0] for r in first], np.int64), len(first), parts)
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], books=books):
            files = [VaFile(b) for b in books]
            total, count = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
            for batch in batches:
                for _, vectors in _vectors(batch, parts):
                    for part, (file, queries) in enumerate(zip(files, vectors, strict=True)):
                        best, _, _ = file.nearest(queries)
                        np.add.at(total[part], best, queries)
                        count[part] += np.bincount(best, minlength=books.shape[1])
            part, entry = np.nonzero(count)
            yield pa.RecordBatch.from_pydict({"part": part, "entry": entry, "n": count[part, entry], "s": list(total[part, entry])}, schema=SUMS)

        # Positions are added up one by one, as decimals: a sum over all rows may pass a long.
        each = made.select("_v").mapInArrow(sums, "part int, entry int, n long, s array<long>")
        each = each.select("part", "entry", "n", F.posexplode("s").alias("pos", "x"))
        for r in each.groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(19,0)")).alias("s")).collect():
            if r.n:
                books[r.part, r.entry, r.pos] = int(r.s) // r.n
    return books


SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))])


def encode(made: DataFrame, books: np.ndarray) -> DataFrame:
    """``integers`` with ``_code`` (an entry's number a part) and ``_error`` (squared distances to the entries, summed)
    in place of the vector."""
    schema = made.select("_id", "_doc").schema.add("_code", "binary").add("_error", "long").add("_compared", "long")

    def run(batches: Iterator[pa.RecordBatch]):
        files = [VaFile(b) for b in books if len(b)]
        for batch in batches:
            for piece, vectors in _vectors(batch, len(books)):
                found = [file.nearest(queries) for file, queries in zip(files, vectors, strict=True)]
                code = np.stack([best for best, _, _ in found], axis=1).astype(np.uint8)
                error = sum(off for _, off, _ in found)
                compared = np.zeros(len(code), np.int64)
                compared[:1] = sum(n for _, _, n in found)
                yield pa.RecordBatch.from_arrays([piece.column("_id"), piece.column("_doc"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error), pa.array(compared)], names=["_id", "_doc", "_code", "_error", "_compared"])

    return made.select("_id", "_v", "_doc").mapInArrow(run, schema)


def decode(coded: DataFrame, books: np.ndarray, length: int) -> DataFrame:
    """``coded`` with ``_near``, the integer vector that the code stands for."""
    parts = [F.lit(b.tolist()) for b in books]
    near = F.flatten(F.array(*(F.get(p, F.conv(F.hex(F.substring("_code", k + 1, 1)), 16, 10).cast("int")) for k, p in enumerate(parts))))
    return coded.withColumn("_near", F.slice(near, 1, length))


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(df: DataFrame, ident: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256``, the code in hex digits, of all rows that stay."""
    made = integers(df, ident, vector, [label])
    books = train(made)
    group: Column = F.coalesce(F.concat(F.lit("v"), F.col(f"_doc.`{label}`").cast("string")), F.lit("n"))
    coded = staged(encode(made, books).select("_id", "_code", "_error", group.alias("_label")), "codes")
    sums = staged(coded.groupBy("_label").agg(F.sum(F.col("_error").cast("decimal(19,0)")).cast("long").alias("_sum"), F.count("*").alias("_w")), "errors")
    return lookup(coded, sums, "_label", "_w").select(
        F.col("_id").alias("vec_id"),
        F.lower(F.hex("_code")).alias("code"),
        F.col("_error").alias("error"),
        F.col("_sum").alias("label_error"),
        F.lit(digest(books)).alias("codebooks_sha256"),
    )

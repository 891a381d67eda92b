"""Spectra, bases and cross-validated reconstruction: sums of products in Spark, eigenvectors of small matrices here."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .covariance import as_matrix


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, descending, and eigenvectors (columns) of a symmetric matrix, the largest entry of each positive."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    top = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.where(vectors[top, np.arange(values.size)] < 0, -1.0, 1.0)


def positive_rank(values: np.ndarray) -> int:
    return int((values > 1e-10 * max(1.0, float(np.abs(values).max(initial=0)))).sum())


def positive_part(matrix: np.ndarray, tolerance: bool = False) -> np.ndarray:
    """The matrix without its negative eigenvalues (``tolerance``: nor those that count as 0)."""
    values, vectors = eigen(matrix)
    low = 1e-10 * max(1.0, float(np.abs(values).max(initial=0))) if tolerance else 0.0
    return (vectors * np.where(values > low, values, 0)) @ vectors.T


def projector_overlap(a: np.ndarray, b: np.ndarray) -> float:
    return float((np.abs(a.T @ b) ** 2).sum() / a.shape[1])


def principal_angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.degrees(np.arccos(np.clip(np.linalg.svd(a.T @ b, compute_uv=False), -1, 1)))


def trace_capture(matrix: np.ndarray, basis: np.ndarray) -> float:
    return float(np.trace(basis.T @ matrix @ basis) / np.trace(matrix))


def fourier_basis(d: int, n: int = V.LENGTH) -> np.ndarray:
    return np.array([V.fourier_vector(k // 2 + 1, "cos" if k % 2 == 0 else "sin", n) for k in range(d)]).T


def random_basis(rng: np.random.Generator, d: int, n: int = V.LENGTH) -> np.ndarray:
    """An orthonormal basis of random directions without a constant part."""
    x = rng.normal(size=(n, d))
    return np.linalg.qr(x - x.mean(axis=0))[0]


def sign_aligned(basis: np.ndarray, stored: np.ndarray) -> np.ndarray:
    return basis * np.where((basis * stored).sum(axis=0) < 0, -1.0, 1.0)


def spectrum_table(spark, values: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(values)], "k int, value double")


def spectrum_metrics(spectrum: DataFrame, value: str = "value") -> DataFrame:
    """``n, rank, effective_rank, d90, d95, negative_mass`` of a table of eigenvalues."""
    top = F.max(F.abs(F.col(value))).over(Window.partitionBy())
    s = spectrum.withColumn("_p", F.when(F.col(value) > 1e-10 * F.greatest(F.lit(1.0), top), F.col(value)))
    s = s.withColumn("_share", F.col("_p") / F.sum("_p").over(Window.partitionBy())).withColumn("_r", F.row_number().over(Window.orderBy(F.desc(value))))
    s = s.withColumn("_cum", F.sum("_share").over(Window.orderBy("_r")))
    negative = F.sum(F.when(F.col(value) < 0, -F.col(value)).otherwise(0.0)) / F.sum(F.abs(F.col(value)))
    return s.agg(
        F.count("*").alias("n"),
        F.count("_p").alias("rank"),
        F.exp(-F.sum(F.col("_share") * F.ln("_share"))).alias("effective_rank"),
        F.min(F.when(F.col("_cum") >= 0.9 - 1e-12, F.col("_r"))).alias("d90"),
        F.min(F.when(F.col("_cum") >= 0.95 - 1e-12, F.col("_r"))).alias("d95"),
        negative.alias("negative_mass"),
    )


def element_means(df: DataFrame, vectors: list[str]) -> np.ndarray:
    """Means of the elements of the joined vectors."""
    rows = df.dropna(subset=vectors).select(F.posexplode(F.concat(*vectors)).alias("p", "x")).groupBy("p").agg(F.avg("x").alias("x")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r["p"]] = r["x"]
    return out


def grouped_moments(df: DataFrame, group: str, vectors: list[str], shift: np.ndarray) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sums and sums of products of the joined vectors, less ``shift``, by (few) integer groups: one matrix a
    group and task. A shift near the means keeps the products from cancelling."""

    def run(batches: Iterator[pa.RecordBatch]):
        held: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.concatenate([as_matrix(c) for c in batch.columns[1:]], axis=1) - shift
            g = batch.column(0).to_numpy(zero_copy_only=False)
            for k in np.unique(g):
                own = x[g == k]
                part = [float(len(own)), own.sum(axis=0), own.T @ own]
                held[int(k)] = part if int(k) not in held else [p + q for p, q in zip(held[int(k)], part, strict=True)]
        for k, (n, s, m) in held.items():
            yield pa.RecordBatch.from_pydict({"g": [k], "v": [np.concatenate([[n], s, m.ravel()])]})

    parts = df.dropna(subset=vectors).select(F.col(group).cast("long"), *vectors).mapInArrow(run, "g long, v array<double>")
    out = {}
    for g, v in summed_vectors(parts, "g", "v").items():
        k = int(round((-1 + np.sqrt(1 + 4 * (v.size - 1))) / 2))
        out[g] = (v[0], v[1 : 1 + k], v[1 + k :].reshape(k, k))
    return out


def summed_vectors(parts: DataFrame, key: str, vector: str) -> dict:
    """Sums of (few, bounded) vectors by key, on the driver."""
    long = parts.select(key, F.posexplode(vector).alias("p", "x")).groupBy(key, "p").agg(F.sum("x").alias("x"))
    rows = long.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("v")).collect()
    return {r[key]: np.array(r["v"]) for r in rows}


def split_operators(df: DataFrame, ident: str, odd: str, even: str, splits: int) -> dict[int, list[np.ndarray]]:
    """Symmetric cross-covariances of both halves of each split, from one pass over the rows.

    Rows are dealt to halves by a hash of the split and ``ident``; a task sums the products of all splits.
    """
    shift = element_means(df, [odd, even])
    d = shift.size // 2
    halves = F.array(*(F.pmod(F.xxhash64(F.lit(k), F.col(ident)), F.lit(2)) for k in range(splits)))

    def run(batches: Iterator[pa.RecordBatch]):
        total = 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            h, o, e = (as_matrix(c) for c in batch.columns)
            o, e = o - shift[:d], e - shift[d:]
            parts = []
            for k in range(splits):
                for side in (0, 1):
                    own = h[:, k] == side
                    parts.append(np.concatenate([[own.sum()], o[own].sum(axis=0), e[own].sum(axis=0), (o[own].T @ e[own]).ravel()]))
            total = total + np.stack(parts)
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * splits)), pa.array(list(total))], names=["s", "v"])

    parts = df.dropna(subset=[odd, even]).select(halves.alias("h"), odd, even).mapInArrow(run, "s long, v array<double>")
    out: dict[int, list[np.ndarray]] = {}
    for s, v in sorted(summed_vectors(parts, "s", "v").items()):
        n, so, se, p = v[0], v[1 : 1 + d], v[1 + d : 1 + 2 * d], v[1 + 2 * d :].reshape(d, d)
        if n > 1:
            c = (p - np.outer(so, se) / n) / (n - 1)
            out.setdefault(s // 2, []).append((c + c.T) / 2)
    return out


class Folds:
    """Moments of all, odd and even representatives by fold, and what any basis reconstructs out of fold."""

    def __init__(self, df: DataFrame, fold: str, columns: list[str]):
        self.shift = element_means(df, columns)
        self.parts = grouped_moments(df, fold, columns, self.shift)
        self.size = next(iter(self.parts.values()))[1].size // len(columns)
        self.names = columns
        self.whole = [sum(p[i] for p in self.parts.values()) for i in range(3)]

    def _cov(self, m, a: int, b: int) -> np.ndarray:
        n, s, p = m
        d = self.size
        sa, sb = s[a * d : (a + 1) * d], s[b * d : (b + 1) * d]
        return (p[a * d : (a + 1) * d, b * d : (b + 1) * d] - np.outer(sa, sb) / n) / (n - 1)

    def train(self, fold: int):
        return [w - p for w, p in zip(self.whole, self.parts[fold], strict=True)]

    def replicate_operator(self, moments=None) -> np.ndarray:
        c = self._cov(self.whole if moments is None else moments, 1, 2)
        return (c + c.T) / 2

    def mean_covariance(self, moments=None) -> np.ndarray:
        return self._cov(self.whole if moments is None else moments, 0, 0)

    def scatter(self, fold: int, which: int) -> np.ndarray:
        """Sum of products of a fold's rows about the training mean of the first vector."""
        n, s, p = self.parts[fold]
        d, train = self.size, self.train(fold)
        own = slice(which * d, (which + 1) * d)
        mean = train[1][:d] / train[0] + self.shift[:d] - self.shift[own]
        return p[own, own] - np.outer(s[own], mean) - np.outer(mean, s[own]) + n * np.outer(mean, mean)

    def r2(self, bases: dict[int, np.ndarray], which: int = 0) -> float:
        """Pooled over folds; ``bases`` by fold. The error is the total less the energy in the basis."""
        sse = sst = 0.0
        for f, b in bases.items():
            t = self.scatter(f, which)
            sst += np.trace(t)
            sse += np.trace(t) - np.trace(b.T @ t @ b)
        return 1 - sse / sst

    def bases(self, d: int, kind: str) -> dict[int, np.ndarray]:
        out = {}
        for f in self.parts:
            m = self.train(f)
            values, vectors = eigen(self.replicate_operator(m) if kind == "replicate" else self.mean_covariance(m))
            if d <= positive_rank(values):
                out[f] = vectors[:, :d]
        return out


def reconstruction_curve(folds: Folds, most: int = 24) -> list[tuple]:
    """``(dimension, replicate all, odd, even, ordinary all)`` for dimensions that every fold allows."""
    rows = []
    for d in range(1, most + 1):
        a, b = folds.bases(d, "replicate"), folds.bases(d, "ordinary")
        if len(a) == len(b) == len(folds.parts):
            rows.append((d, *(float(folds.r2(a, k)) for k in (0, 1, 2)), float(folds.r2(b, 0))))
    return rows


def chosen_dimension(curve: DataFrame, least: float = 0.9, part: float = 0.95, least_half: float = 0.85) -> DataFrame:
    """The least dimension whose R² reaches the floor and a part of the ceiling, in all and in both halves."""
    top = F.max("r2_all").over(Window.partitionBy())
    ok = (F.col("r2_all") >= F.greatest(F.lit(least), part * F.col("_top"))) & (F.col("r2_odd") >= least_half) & (F.col("r2_even") >= least_half)
    return curve.withColumn("_top", top).agg(F.max("_top").alias("ceiling"), F.min(F.when(ok, F.col("dimension"))).alias("dimension"))


def merged_curves(main: DataFrame, other: DataFrame, prefix: str, on: str = "dimension") -> DataFrame:
    """A curve with the columns of another one beside it, null at dimensions that the other lacks."""
    return main.join(other.select(on, *(F.col(c).alias(prefix + c) for c in other.columns if c != on)), on, "left")

"""Where along the phase a direction's energy lies: profiles, windows, the best directions of a basis."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = {"shape": 0, "slope": 1, "curvature": 2}
WIDTHS = (4, 8, 16)


def window_sums(profile: DataFrame, keys: list[str], pos: str, value: str, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """``keys, width, start, total``: sums over every contiguous window that fits."""
    out = None
    for w in widths:
        over = Window.partitionBy(*keys).orderBy(pos).rowsBetween(0, w - 1)
        rows = profile.select(*keys, F.lit(w).alias("width"), F.col(pos).alias("start"), F.sum(value).over(over).alias("total"), F.count("*").over(over).alias("_n"))
        rows = rows.where(F.col("_n") == w).drop("_n")
        out = rows if out is None else out.unionByName(rows)
    return out


def best_window(windows: DataFrame, keys: list[str]) -> DataFrame:
    """The window of the largest sum for each key and width, the first of equals (to twelve digits)."""
    order = Window.partitionBy(*keys, "width").orderBy(F.desc(F.round("total", 12)), "start")
    return windows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def outside_guard(windows: DataFrame, start: int, width: int) -> DataFrame:
    """Windows that keep half a width (rounded up) from a given one."""
    guard = (width + 1) // 2
    return windows.where((F.col("start") + F.col("width") <= start - guard) | (F.col("start") >= start + width + guard))


def window_overlap(a: int, b: int, width: int) -> float:
    return max(0, width - abs(a - b)) / width


def top_direction(basis: np.ndarray, metric: str, start: int, width: int) -> tuple[float, np.ndarray]:
    """The unit combination of basis columns with the largest part of its energy in a window, and that part."""
    x = np.diff(basis, METRICS[metric], axis=0)
    total, inside = x.T @ x, x[start : start + width].T @ x[start : start + width]
    values, vectors = np.linalg.eigh(total)
    keep = values > 1e-12 * values.max()
    white = vectors[:, keep] / np.sqrt(values[keep])
    parts, directions = np.linalg.eigh(white.T @ inside @ white)
    c = white @ directions[:, -1]
    c /= np.linalg.norm(c)
    return float(parts[-1]), c if c[np.abs(c).argmax()] > 0 else -c


def scan(spark, basis: np.ndarray, metrics: tuple[str, ...] = tuple(METRICS), widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """``metric, width, start, fraction, direction`` for every window, a grid row at a time."""
    n = basis.shape[0]
    grid = [(m, w, s) for m in metrics for w in widths for s in range(n - METRICS[m] - w + 1)]

    def run(frames: Iterator[pd.DataFrame]):
        for frame in frames:
            found = [top_direction(basis, m, s, w) for m, w, s in zip(frame["metric"], frame["width"], frame["start"], strict=True)]
            yield frame.assign(fraction=[f for f, _ in found], direction=[c.tolist() for _, c in found])

    return spark.createDataFrame(grid, "metric string, width int, start int").repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, "metric string, width int, start int, fraction double, direction array<double>")


def best(scanned: DataFrame) -> DataFrame:
    order = Window.partitionBy("metric", "width").orderBy(F.desc("fraction"), "start")
    return scanned.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def without(basis: np.ndarray, direction: np.ndarray) -> np.ndarray:
    """A basis of what is orthogonal to a direction within the span of ``basis``."""
    c = np.asarray(direction, float)[:, None]
    null = np.linalg.svd(c.T)[2][1:].T
    return basis @ null


def axis_pairs(windows: DataFrame) -> DataFrame:
    """``i, j, fraction, rank``: the best part of window energy of two axes, from ``i, j, g`` (window Gram matrix of an
    orthonormal basis), by the closed form of a 2 by 2 matrix."""
    own = windows.where("i = j").select("i", "g")
    pair = windows.where("i < j").join(own.withColumnRenamed("g", "a"), "i").join(own.select(F.col("i").alias("j"), F.col("g").alias("c")), "j")
    half = (F.col("a") - F.col("c")) / 2
    out = pair.select("i", "j", ((F.col("a") + F.col("c")) / 2 + F.sqrt(half * half + F.col("g") * F.col("g"))).alias("fraction"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("fraction", 12)), "i", "j")))

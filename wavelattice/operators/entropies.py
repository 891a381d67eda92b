"""Entropy gains of a patient's vectors when links between blocks of positions are cut, and their surrogates.

All comes from sums of products. A surrogate permutes parts of the vectors among the patient's rows by keyed bijections on
row numbers, which any task works out for any rows: a patient of any size is cut into chunks, tasks return sums about a
common shift, and only those meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Matrix, staged, write_matrix
from .nulls import keyed_order
from .sweeps import Running, running

#: Rows of a chunk, which is what one task reads at once, surrogates of a batch, and permuted numbers held at once.
CHUNK, BATCH, HELD = 16_384, 32, 1 << 17
#: Blocks of positions whose gain is reported, and those that a surrogate permutes.
CUTS, PERMUTED = {"2": 2, "4": 4, "8": 8}, 4


def entropy(matrix: np.ndarray) -> float:
    """Von Neumann entropy of a covariance scaled to trace 1."""
    values = np.clip(np.linalg.eigvalsh(matrix / np.trace(matrix)), 0, None)
    values = values[values > 0]
    return float(-(values * np.log(values)).sum())


def pinched(matrix: np.ndarray, blocks: int) -> np.ndarray:
    """The matrix without what links different blocks of positions."""
    own = np.arange(len(matrix)) * blocks // len(matrix)
    return np.where(own[:, None] == own, matrix, 0.0)


def gains(covariance: np.ndarray) -> dict[str, float]:
    """Entropy gained when only 2, 4, 8 blocks or single positions keep their covariance."""
    base = entropy(covariance)
    return {f"delta_{k}": entropy(pinched(covariance, b)) - base for k, b in [*CUTS.items(), ("all", len(covariance))]}


def entropy_gains(x: np.ndarray) -> dict[str, float]:
    return gains(np.cov(x.T))


# ---------------------------------------------------------------- forms of a row


def _centred(x: np.ndarray) -> np.ndarray:
    return x - x.mean(axis=1, keepdims=True)


def _normalised(x: np.ndarray) -> np.ndarray:
    c = _centred(x)
    sd = c.std(axis=1, keepdims=True)
    return c / np.where(sd > 1e-12, sd, np.nan)


#: What a row becomes behind its permutation, as a surrogate of a shape is one of pressures, brought to its form anew.
FORMS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"as_is": lambda x: x, "centred": _centred, "normalised": _normalised}


# ---------------------------------------------------------------- surrogates


def part_of(width: int, kind: str) -> np.ndarray:
    """The part that each position belongs to: one of four blocks, or one of its own."""
    return np.arange(width) * PERMUTED // width if kind == "blocks" else np.arange(width)


def patient_seed(seed: int, patient: str | None, kind: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{seed}|{patient}|{kind}".encode()).digest()[:3], "little")


def partners(rows: np.ndarray, n: int, seed: int, rep: int, parts: int) -> np.ndarray:
    """For rows of a patient of ``n``: whose value each part of them takes in a replicate (row, part)."""
    if rep == 0:
        return np.repeat(rows[:, None], parts, axis=1)
    return keyed_order(rows[:, None], n, seed, rep * parts + np.arange(parts)[None, :])


def _sums(data: Matrix, start: int, n: int, at: int, reps: range, seed: int, kind: str, form: str, chunk: int) -> np.ndarray:
    """For each replicate, the sums and sums of products of a chunk's rows about a shift that all chunks share."""
    width, shape = data.width, FORMS[form]
    own, whole = part_of(width, kind), data.read(start, start + n) if n <= chunk else None
    first = shape(data.read(start, start + min(n, 1024)))
    shift = np.nan_to_num(first.mean(axis=0))
    parts = int(own[-1]) + 1
    out = np.zeros((len(reps), width + width * width))
    step = max(1, HELD // (parts * (1 if whole is not None else 4)))
    for low in range(at, min(at + chunk, n), step):
        rows = np.arange(low, min(low + step, at + chunk, n))
        for k, rep in enumerate(reps):
            if rep == 0:
                y = data.read(start + rows[0], start + rows[-1] + 1)
            else:
                where = partners(rows, n, seed, rep, parts)
                if whole is not None:
                    y = np.take_along_axis(whole, where[:, own], axis=0)
                else:
                    y = np.empty((rows.size, width))
                    for part in range(parts):
                        y[:, own == part] = data.take(start + where[:, part])[:, own == part]
            y = shape(y) - shift
            out[k, :width] += y.sum(axis=0)
            out[k, width:] += (y.T @ y).ravel()
    return out


def _deltas(sums: np.ndarray, n: int, width: int, rep: int) -> list[float]:
    """All gains of replicate 0, and the one of four blocks of any other; NaN where there is no variance or no shape."""
    s, products = sums[:width], sums[width:].reshape(width, width)
    names = [f"delta_{k}" for k in (*CUTS, "all")]
    if n < 2 or not np.isfinite(sums).all():
        return [np.nan] * len(names)
    c = (products - np.outer(s, s) / n) / (n - 1)
    if np.trace(c) <= 1e-12 * max(1.0, np.trace(products)):
        return [np.nan] * len(names)
    if rep == 0:
        found = gains(c)
        return [found[k] for k in names]
    return [entropy(pinched(c, PERMUTED)) - entropy(c) if k == f"delta_{PERMUTED}" else np.nan for k in names]


_MOMENTS = "p string, n long, rep int, deltas array<double>, sums array<double>"
_MOMENT_ROWS = pa.schema([("p", pa.string()), ("n", pa.int64()), ("rep", pa.int32()), ("deltas", pa.list_(pa.float64())), ("sums", pa.list_(pa.float64()))])


def block_entropies(beats: DataFrame, patient: str, vector: str, surrogates: int = 0, seed: int = 0, kind: str = "blocks", order: list[str] | None = None, form: str = "as_is", chunk: int = CHUNK) -> DataFrame:
    """``patient, n, delta_2, delta_4, delta_8, delta_all`` and, with surrogates, ``excess_4``: the gain over the median
    of surrogates in which each of four blocks of positions is permuted among the patient's beats on its own.

    ``kind``: "blocks", or "positions" for surrogates in which every position is permuted on its own. ``form``: what a row
    becomes once it is permuted ("as_is", "centred", "normalised"). ``order`` numbers a patient's rows (by default the
    vectors themselves do), so that reruns agree. Rows without a vector are left out; a patient of one row, without
    variance or with a row that has no shape has NaN; an empty table gives none.

    Rows are written once in the order of patients. A task takes a ``chunk`` of a patient's rows and a batch of surrogates. A
    patient of one chunk is finished there; of a larger one only sums meet, added up in tasks first.
    """
    numbered = ["p", *(f"_o{i}" for i, _ in enumerate(order or [vector]))]
    rows = beats.where(F.col(vector).isNotNull()).select(F.col(patient).cast("string").alias("p"), F.col(vector).alias("v"), *(F.col(c).alias(n) for c, n in zip(order or [vector], numbered[1:], strict=True)))
    rows = staged(rows, "vectors")
    data = write_matrix(rows, numbered, ["v"])
    width = data.width
    counts = rows.groupBy("p").agg(F.count("*").alias("n")).withColumn("_all", F.lit(0))
    patients = running(counts, "_all", ["p"], {"_stop": Running("sum", F.col("n"))}).select("p", "n", (F.col("_stop") - F.col("n")).alias("start"))
    batches = -(-(surrogates + 1) // BATCH)
    units = patients.select("p", "n", "start", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch")).select("p", "n", "start", "batch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(chunk).cast("long"))).alias("at"))
    tasks = 4 * beats.sparkSession.sparkContext.defaultParallelism
    # Chunks of one patient and batch lie side by side, so that a task adds them up; a hot one is cut by ``at``.
    dealt = staged(units, "units").repartitionByRange(tasks, "p", "batch", "at").sortWithinPartitions("p", "batch", "at")

    def out(name: tuple, n: int, reps: range, sums: np.ndarray) -> pa.RecordBatch:
        whole = n <= chunk
        made = [{"p": name[0], "n": n, "rep": rep, "deltas": _deltas(own, n, width, rep) if whole else None, "sums": None if whole else own.tolist()} for rep, own in zip(reps, sums, strict=True)]
        return pa.RecordBatch.from_pylist(made, schema=_MOMENT_ROWS)

    def run(ranges: Iterator[pa.RecordBatch]):
        held = None
        for unit in (u for b in ranges for u in b.to_pylist()):
            name = (unit["p"], unit["batch"])
            reps = range(unit["batch"] * BATCH, min((unit["batch"] + 1) * BATCH, surrogates + 1))
            sums = _sums(data, unit["start"], unit["n"], unit["at"], reps, patient_seed(seed, unit["p"], kind), kind, form, chunk)
            if held and held[0] == name:
                np.add(held[3], sums, out=held[3])
                continue
            if held:
                yield out(*held)
            held = (name, unit["n"], reps, sums)
        if held:
            yield out(*held)

    made = staged(dealt.mapInArrow(run, _MOMENTS), "moments")
    parts = made.where("deltas is null").select("p", "n", "rep", F.posexplode("sums").alias("pos", "x")).groupBy("p", "n", "rep", "pos").agg(F.sum("x").alias("x"))
    met = parts.groupBy("p", "n", "rep").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("sums"))

    def finish(batches_: Iterator[pa.RecordBatch]):
        for b in batches_:
            yield pa.RecordBatch.from_pylist([r | {"deltas": _deltas(np.array(r.pop("sums")), r["n"], width, r["rep"])} for r in b.to_pylist()], schema=_DELTA_ROWS)

    each = made.where("deltas is not null").select("p", "n", "rep", "deltas").unionByName(met.mapInArrow(finish, "p string, n long, rep int, deltas array<double>"))
    first = [F.max(F.when(F.col("rep") == 0, F.col("deltas")[i])).alias(f"delta_{k}") for i, k in enumerate((*CUTS, "all"))]
    excess = F.max(F.when(F.col("rep") == 0, F.col("deltas")[1])) - F.when(F.count_if((F.col("rep") > 0) & F.isnan(F.col("deltas")[1])) == 0, F.median(F.when(F.col("rep") > 0, F.col("deltas")[1])))
    excess = F.coalesce(excess, F.lit(float("nan")))
    return each.groupBy("p").agg(F.first("n").alias("n"), *first, excess.alias("excess_4")).withColumnRenamed("p", patient)


_DELTA_ROWS = pa.schema([f for f in _MOMENT_ROWS if f.name != "sums"])

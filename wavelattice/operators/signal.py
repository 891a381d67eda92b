"""Pressure waveforms to beats: a band-pass filter, peaks, resampled shapes and their checks. A case is a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V

FS, LOW, HIGH = 125.0, 0.5, 5.0
DISTANCE, PROMINENCE = 37, 0.30


def band_pass(low: float = LOW, high: float = HIGH, fs: float = FS) -> tuple[np.ndarray, np.ndarray]:
    """A second-order Butterworth band-pass by the bilinear transform of its analogue poles."""
    w1, w2 = (2 * fs * np.tan(np.pi * f / fs) for f in (low, high))
    width, centre = w2 - w1, np.sqrt(w1 * w2)
    poles = []
    for p in np.exp(1j * np.pi * np.array([3, 5]) / 4):
        root = np.sqrt((p * width / 2) ** 2 - centre**2 + 0j)
        poles += [p * width / 2 + root, p * width / 2 - root]
    poles = np.array(poles)
    z = (2 * fs + poles) / (2 * fs - poles)
    gain = width**2 * (2 * fs) ** 2 / np.prod(2 * fs - poles)
    return np.real(gain) * np.real(np.poly([1, 1, -1, -1])), np.real(np.poly(z))


def filtered(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray, block: int = 512) -> np.ndarray:
    """Transposed direct form II, a block of samples at a time.

    Within a block the output is a product of the inputs with the impulse response plus what the state at its start
    leaves; only the state is carried from block to block.
    """
    n = len(a) - 1
    step = np.zeros((n, n))
    step[:, 0] = -a[1:]
    step[np.arange(n - 1), np.arange(1, n)] = 1
    gain = b[1:] - a[1:] * b[0]
    powers = np.empty((block + 1, n, n))
    powers[0] = np.eye(n)
    for k in range(block):
        powers[k + 1] = powers[k] @ step
    free = powers[:block, 0]  # what the state adds to each output
    impulse = np.concatenate([[b[0]], free[:-1] @ gain])
    lag = np.arange(block)[:, None] - np.arange(block)
    response = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
    carried = (powers[:block] @ gain)[::-1]  # what each input leaves in the state at the end
    out, z = np.empty_like(x), np.array(state, float)
    for at in range(0, x.size, block):
        own = x[at : at + block]
        m = own.size
        out[at : at + m] = response[:m, :m] @ own + free[:m] @ z
        z = powers[m] @ z + carried[block - m :].T @ own
    return out


def zero_phase(x: np.ndarray, b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Forward and backward, with odd padding and the steady state of a constant at both ends."""
    pad = 3 * len(a)
    if x.size <= pad:
        raise ValueError("the signal is too short to filter")
    n = len(a) - 1
    companion = np.zeros((n, n))
    companion[0] = -a[1:]
    companion[np.arange(1, n), np.arange(n - 1)] = 1
    zi = np.linalg.solve(np.eye(n) - companion.T, b[1:] - a[1:] * b[0])
    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    y = filtered(b, a, wide, zi * wide[0])[::-1]
    return filtered(b, a, y, zi * y[0])[::-1][pad:-pad]


def peaks(x: np.ndarray, distance: int = DISTANCE, prominence: float = PROMINENCE) -> np.ndarray:
    """Middles of strict plateaus, the higher first where two are nearer than ``distance``, prominent enough."""
    step = np.flatnonzero(np.diff(x) != 0)
    rise = np.sign(np.diff(x)[step])
    top = np.flatnonzero((rise[:-1] > 0) & (rise[1:] < 0))
    at = (step[top] + 1 + step[top + 1]) // 2
    keep = np.ones(at.size, bool)
    for k in np.argsort(x[at], kind="stable")[::-1].tolist():
        if keep[k]:
            low, high = np.searchsorted(at, [at[k] - distance + 1, at[k] + distance])
            keep[low:high] = False
            keep[k] = True
    places = np.unique(np.concatenate([[0], at, [x.size - 1]]))
    left, right = _bases(x, places), _bases(x[::-1], x.size - 1 - places[::-1])[::-1]
    prominent = x[places] - np.maximum(left, right) >= prominence
    return at[keep & prominent[np.searchsorted(places, at)]]


def _bases(x: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The least value between each place and the nearest higher one on its left, or the start.

    ``places``: both ends and all tops, between which a signal only falls and rises. A stack holds the places that are
    higher than all behind them, each with the least value back to the one before.
    """
    valleys = np.minimum.reduceat(x, places)
    out, held = np.empty(places.size), []
    for k, top in enumerate(x[places].tolist()):
        low = min(top, valleys[k - 1]) if k else top
        while held and held[-1][0] <= top:
            low = min(low, held.pop()[1])
        out[k] = low
        held.append((top, low))
    return out


def zscore(x: np.ndarray) -> np.ndarray:
    return (x - x.mean()) / x.std()


def catalog(x: np.ndarray, fs: float) -> pd.DataFrame:
    """Beats between the middles of neighbouring peaks, centred at their peak, 0.3 to 2 seconds long, at 64 phases; empty
    where there are fewer than eight."""
    bad = ~np.isfinite(x)
    if bad.all():
        raise ValueError("no finite sample")
    x = np.where(bad, np.interp(np.arange(x.size), np.flatnonzero(~bad), x[~bad]), x)
    rows = []
    p = peaks(zscore(zero_phase(zscore(x), *band_pass(fs=fs)))) if x.std() > 0 else np.empty(0, int)
    mids = (p[:-1] + p[1:]) // 2
    if p.size >= 4:
        for left, right, top in zip(mids[:-1], mids[1:], p[1:-1], strict=True):
            seconds = (right - left) / fs
            v = np.interp(np.arange(64) / 64 * (right - left), np.arange(right - left + 1), x[left : right + 1])
            if 0.3 <= seconds <= 2 and np.ptp(v) > 1e-8 and v.std() > 1e-10:
                rows.append((left / fs, right / fs, top / fs, seconds, v.tolist()))
    rows = rows if len(rows) >= 8 else []
    return pd.DataFrame(rows, columns=["left_sec", "right_sec", "center_sec", "duration_sec", "absolute"])


BEATS = "patient_id string, beat_id int, left_sec double, right_sec double, center_sec double, duration_sec double, absolute array<double>, failure string"


def beat_catalog(cases: DataFrame) -> DataFrame:
    """Beats of each case (``patient_id, fs, abp``); a case that fails gives one row with the reason."""

    def run(frames: Iterator[pd.DataFrame]):
        for frame in frames:
            for case in frame.itertuples():
                try:
                    beats, failure = catalog(np.asarray(case.abp, float), float(case.fs)), None
                    if beats.empty:
                        failure = "too few beats"
                except ValueError as e:
                    beats, failure = pd.DataFrame(), str(e)
                if failure:
                    yield pd.DataFrame([(case.patient_id, None, None, None, None, None, None, failure)], columns=[c.split()[0] for c in BEATS.split(", ")])
                else:
                    yield beats.assign(patient_id=case.patient_id, beat_id=np.arange(len(beats)), failure=None)[[c.split()[0] for c in BEATS.split(", ")]]

    return cases.select("patient_id", "fs", "abp").mapInPandas(run, BEATS)


def representations(beats: DataFrame) -> DataFrame:
    """Centred and normalised shapes and pressures; a patient of which one beat has no shape loses all."""
    v = F.col("absolute")
    out = beats.where("failure is null").select("*", V.centred(v).alias("pulse_centered"), V.normalised(v).alias("shape_norm"), V.peak_to_peak(v).alias("pp"), V.mean(v).alias("map_proxy"), F.array_max(v).alias("sbp"), F.array_min(v).alias("dbp"))
    whole = out.groupBy("patient_id").agg(F.bool_and(F.col("shape_norm").isNotNull()).alias("_ok")).where("_ok")
    return out.join(whole.select("patient_id"), "patient_id", "left_semi")


def quality_masks(beats: DataFrame, *, correlation: float = 0.75) -> DataFrame:
    """``beats`` with ``n_before``, ``correlation`` and ``kept``: whether the shape follows the patient's median shape and
    neither duration nor log pulse is an outlier. Template, medians and deviations all come from the same rows."""
    from .blocks import deviation_kept, template_correlation

    rows = template_correlation(beats, ["patient_id"], "shape_norm")
    rows = deviation_kept(rows, ["patient_id"], "duration_sec", "_a").drop("_mid", "_mad")
    rows = deviation_kept(rows.withColumn("_log", F.ln("pp")), ["patient_id"], "_log", "_b").drop("_mid", "_mad", "_log")
    counts = beats.groupBy("patient_id").agg(F.count("*").alias("n_before"))
    kept = F.coalesce((F.col("correlation") >= correlation) & F.col("_a") & F.col("_b"), F.lit(False))
    return rows.join(counts, "patient_id").withColumn("kept", kept).drop("_a", "_b")


def quality(beats: DataFrame, *, least_before: int = 8, least: int = 6, correlation: float = 0.75) -> DataFrame:
    """The beats that pass ``quality_masks``, of patients with ``least_before`` beats before and ``least`` behind it."""
    rows = quality_masks(beats, correlation=correlation).where((F.col("n_before") >= least_before) & F.col("kept"))
    enough = rows.groupBy("patient_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return rows.join(enough.select("patient_id"), "patient_id", "left_semi").drop("n_before", "kept")


# ---------------------------------------------------------------- patients

#: Why a patient has no representatives, in the order of the checks.
REASONS = ["sampling rate", "shorter than the window", "catalog failed", "fewer than 8 beats in the window", "fewer than 6 beats kept", "too few eligible blocks", "no representative shape"]


def _covariance_rows(lists: pa.Array) -> list[list[float]]:
    return [np.cov(np.array(q, float).T, ddof=1 if len(q) > 1 else 0).ravel().tolist() for q in lists.to_pylist()]


def constructed(cases: DataFrame, *, seconds: float = 1800.0, width: float = 60.0, least_beats: int = 32, least: int = 6, least_half: int = 3, fs: float = 125.0) -> tuple[DataFrame, DataFrame]:
    """Patients from waveforms, and why others failed.

    First: ``patient_id, all_rep, odd_rep, even_rep, within_cov`` (the covariance of the block shapes, row by row),
    ``eligible_blocks, odd_blocks, even_blocks, median_block_coherence, median_beats_per_block``. Second: ``patient_id,
    failure``, the first of ``REASONS`` that holds. ``cases``: ``patient_id, fs, abp``, one row a patient.

    The last ``seconds`` are cut first; the quality masks come from the beats in them. Beats kept go to blocks of
    ``width``; a block needs ``least_beats`` beats, a patient ``least`` blocks and ``least_half`` odd and even ones.
    ``least_beats`` 1 is the construction without a gate.
    """
    from ..sources.shared import staged
    from .blocks import central_shape, replicates, tumbling_block

    length = F.size("abp") / F.col("fs")
    sized = cases.select("patient_id", (F.abs(F.col("fs") - fs) <= 1e-6).alias("_rate"), (length + 1e-9 >= seconds).alias("_long"), length.alias("_sec"))
    fit = cases.join(sized.where("_rate and _long").select("patient_id"), "patient_id", "left_semi")
    beats = staged(representations(beat_catalog(fit)).join(sized.select("patient_id", "_sec"), "patient_id"), "beats")
    inside = beats.where((F.col("center_sec") >= F.col("_sec") - seconds) & (F.col("center_sec") <= F.col("_sec")))
    masked = staged(quality_masks(inside), "masked")
    counts = masked.groupBy("patient_id").agg(F.count("*").alias("_before"), F.count_if("kept").alias("_after"))
    passed = counts.where("_before >= 8 and _after >= 6")
    kept = masked.where("kept").join(passed.select("patient_id"), "patient_id", "left_semi")
    placed = kept.withColumn("block", tumbling_block(F.col("center_sec"), F.col("_sec") - seconds, width, int(seconds // width))).where("block is not null")
    shapes = staged(central_shape(placed, ["patient_id", "block"], "shape_norm").where((F.col("n") >= least_beats) & F.col("q").isNotNull()), "shapes")

    odd = F.pmod(F.col("block"), F.lit(2)) == 1
    # A patient has at most one shape a block of the window, so that their list is bounded.
    each = shapes.groupBy("patient_id").agg(
        F.count("*").alias("eligible_blocks"), F.count_if(odd).alias("odd_blocks"), F.count_if(~odd).alias("even_blocks"),
        F.median("kappa").alias("median_block_coherence"), F.median("n").alias("median_beats_per_block"), F.sort_array(F.collect_list(F.struct("block", "q"))).alias("_q"),
    )
    enough = (F.col("eligible_blocks") >= least) & (F.col("odd_blocks") >= least_half) & (F.col("even_blocks") >= least_half)
    names = [c for c in each.columns if c != "_q"]
    wide = each.where(enough).select(*names, F.transform("_q", lambda b: b["q"]).alias("_q"))

    def covariances(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            cov = pa.array(_covariance_rows(batch.column("_q")), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), cov], names=[*names, "within_cov"])

    schema = wide.select(*names).schema.add("within_cov", T.ArrayType(T.DoubleType()))
    reps = replicates(shapes, "patient_id", "block", "q", least=least, least_half=least_half).select("patient_id", "all_rep", "odd_rep", "even_rep")
    reps = reps.where("all_rep is not null and odd_rep is not null and even_rep is not null")
    patients = staged(reps.join(wide.mapInArrow(covariances, schema), "patient_id"), "patients").select("patient_id", "all_rep", "odd_rep", "even_rep", "within_cov", *names[1:])

    found = beats.select("patient_id").distinct().withColumn("_beats", F.lit(True))
    state = sized.join(found, "patient_id", "left").join(counts, "patient_id", "left").join(each.select("patient_id", enough.alias("_enough")), "patient_id", "left").join(patients.select("patient_id", F.lit(True).alias("_done")), "patient_id", "left_anti")
    before, after = F.coalesce("_before", F.lit(0)), F.coalesce("_after", F.lit(0))
    checks = [~F.coalesce("_rate", F.lit(False)), ~F.coalesce("_long", F.lit(False)), F.col("_beats").isNull(), before < 8, after < 6, ~F.coalesce("_enough", F.lit(False)), F.lit(True)]
    reason = F.coalesce(*(F.when(c, F.lit(r)) for c, r in zip(checks, REASONS, strict=True)))
    return patients, state.select("patient_id", reason.alias("failure"))


def shape_invariants(patients: DataFrame, columns: list[str], tolerance: float = 1e-10) -> DataFrame:
    """``column, n, n_wrong``: representatives whose mean is not 0 or deviation not 1 to the tolerance."""
    wrong = [F.count_if((F.abs(V.mean(F.col(c))) > tolerance) | (F.abs(V.population_sd(F.col(c)) - 1) > tolerance)).alias(f"w{i}") for i, c in enumerate(columns)]
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"w{i}").alias("n_wrong")) for i, c in enumerate(columns)]
    one = patients.agg(*(F.count(c).alias(f"n{i}") for i, c in enumerate(columns)), *wrong)
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# ---------------------------------------------------------------- table function


class BeatTable:
    """A case's beats as rows, those of ``beat_catalog``."""

    def eval(self, fs: float, abp: list[float]) -> Iterator[tuple]:
        try:
            beats, failure = catalog(np.array(abp if abp is not None else [], float), float(fs if fs is not None else "nan")), "too few beats"
        except ValueError as e:
            beats, failure = pd.DataFrame(), str(e)
        if beats.empty:
            yield None, None, None, None, None, None, failure
        for k, b in enumerate(beats.itertuples()):
            yield k, float(b.left_sec), float(b.right_sec), float(b.center_sec), float(b.duration_sec), b.absolute, None


def register_beats(spark: SparkSession, name: str = "beats") -> None:
    """Make ``SELECT ... FROM cases, LATERAL beats(cases.fs, cases.abp)`` known to the session; cases are dealt among tasks
    as they lie, and a row a beat comes back."""
    spark.udtf.register(name, F.udtf(BeatTable, returnType=BEATS.removeprefix("patient_id string, "), useArrow=True))

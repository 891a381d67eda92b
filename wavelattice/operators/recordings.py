"""Recordings of any length in pieces: the same filter and peaks as ``signal`` finds in a whole one.

A recording is rows of ``patient_id, at, abp``: consecutive samples from number ``at`` on, cut anywhere. Pieces are never
put together; null and empty ones count as none. A filter carries a number for each pole from sample to sample, and a piece takes them to a linear function
of what they were, so that each piece's start follows from a scan of a few numbers a piece. Peaks meet as rows of (place,
height, least value since the one before). Pieces of some 65,536 samples keep what is scanned far below the samples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import staged
from .signal import DISTANCE, FS, PROMINENCE, band_pass
from .sweeps import Running, running

_KEY = ["patient_id", "at"]
#: Leaders of a block of peaks, and samples of a bucket in which leaders are looked for.
LEADERS, BUCKET = 4096, 1 << 22


def _mapped(rows: DataFrame, fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """``fn`` of every row, which may hold the arrays ``abp`` and others, as a row of ``schema`` behind the key."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i].as_py() if n != "abp" else np.asarray(batch.column(k)[i].values.to_numpy(zero_copy_only=False), float) for k, n in enumerate(batch.schema.names)}
                out.append({k: row[k] for k in _KEY} | fn(row))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=[*_KEY, *names]), schema=pa.schema([("patient_id", pa.string()), ("at", pa.int64()), *((n, _types[t]) for n, t in (c.split() for c in schema.split(", ")))]), preserve_index=False)

    return rows.where("size(abp) > 0").mapInArrow(run, f"patient_id string, at long, {schema}")


_types = {"double": pa.float64(), "long": pa.int64(), "array<double>": pa.list_(pa.float64()), "array<long>": pa.list_(pa.int64()), "boolean": pa.bool_()}


def pieces_of(cases: DataFrame, size: int) -> DataFrame:
    """Whole recordings (``patient_id, abp``) as pieces of ``size`` samples."""
    cut = cases.where(F.size("abp") > 0).select("patient_id", "abp", F.explode(F.sequence(F.lit(0), F.size("abp") - 1, F.lit(size))).alias("_s"))
    return cut.select("patient_id", F.col("_s").cast("long").alias("at"), F.slice("abp", F.col("_s") + 1, size).alias("abp"))


# ---------------------------------------------------------------- gaps, moments


def filled(pieces: DataFrame) -> DataFrame:
    """Null and non-finite samples by linear interpolation, across pieces too, the ends held; recordings without any
    finite sample are left out."""

    def edges(row):
        good = np.flatnonzero(np.isfinite(row["abp"]))
        ends = [(row["at"] + int(k), float(row["abp"][k])) for k in (good[[0, -1]] if good.size else [])]
        return {"f_at": ends[0][0] if ends else None, "f": ends[0][1] if ends else None, "l_at": ends[1][0] if ends else None, "l": ends[1][1] if ends else None}

    small = staged(_mapped(pieces, edges, "f_at long, f double, l_at long, l double"), "edges")
    own = Window.partitionBy("patient_id").orderBy("at")
    before, behind = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(1, Window.unboundedFollowing)
    near = small.select(*_KEY, F.last(F.when(F.col("l_at").isNotNull(), F.struct("l_at", "l")), True).over(before).alias("_b"), F.first(F.when(F.col("f_at").isNotNull(), F.struct("f_at", "f")), True).over(behind).alias("_n"), F.col("f_at").isNotNull().alias("_own"))
    near = near.where("_own or _b is not null or _n is not null").select(*_KEY, F.col("_b.l_at").alias("b_at"), F.col("_b.l").alias("b"), F.col("_n.f_at").alias("n_at"), F.col("_n.f").alias("n"))

    def fill(row):
        x, at = row["abp"], row["at"] + np.arange(row["abp"].size)
        good = np.isfinite(x)
        if good.all():
            return {"abp": x}
        ends = [([row[f"{k}_at"]], [row[k]]) if row[f"{k}_at"] is not None else ([], []) for k in "bn"]
        places, values = np.concatenate([ends[0][0], at[good], ends[1][0]]), np.concatenate([ends[0][1], x[good], ends[1][1]])
        return {"abp": np.where(good, x, np.interp(at, places, values))}

    return _mapped(pieces.join(near, _KEY), fill, "abp array<double>")


def standard(pieces: DataFrame) -> DataFrame:
    """Each recording about its mean, over its population deviation; those that do not vary are left out."""

    def moments(row):
        x = row["abp"]
        return {"m": x.size, "mean": float(x.mean()), "ss": float(((x - x.mean()) ** 2).sum())}

    small = staged(_mapped(pieces, moments, "m long, mean double, ss double"), "moments")
    each = small.groupBy("patient_id").agg(F.sum("m").alias("_n"), (F.sum(F.col("m") * F.col("mean")) / F.sum("m")).alias("mu"))
    spread = small.join(each, "patient_id").groupBy("patient_id", "mu").agg(F.sqrt(F.sum(F.col("ss") + F.col("m") * (F.col("mean") - F.col("mu")) ** 2) / F.first("_n")).alias("sd"))
    known = small.select(*_KEY).join(spread.where("sd > 1e-10"), "patient_id")
    return _mapped(pieces.join(known, _KEY), lambda row: {"abp": (row["abp"] - row["mu"]) / row["sd"]}, "abp array<double>")


# ---------------------------------------------------------------- filter


class Affine:
    """A filter as a sum of one recursion for each of its poles, which must differ: a state is a number for each.

    Behind m samples the state is each pole's m-th power times the one before, plus what the samples leave. In this form
    a state's rounding errors are not blown up, as they are among the sums of the direct form.
    """

    def __init__(self, b: np.ndarray, a: np.ndarray, block: int = 512):
        self.poles, self.block = np.roots(a), block
        weights = np.polyval(b[1:] - a[1:] * b[0], self.poles) / np.polyval(np.polyder(a), self.poles)
        powers = self.poles ** np.arange(block + 1)[:, None]
        impulse = np.concatenate([[b[0]], (powers[: block - 1] @ weights).real])
        lag = np.arange(block)[:, None] - np.arange(block)
        self.powers, self.weights = powers, weights
        self.response = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
        self.steady = 1 / (1 - self.poles)

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Outputs, and the state at the end."""
        out, z = np.empty(x.size), np.array(state, complex)
        for at in range(0, x.size, self.block):
            own = x[at : at + self.block]
            m = own.size
            out[at : at + m] = self.response[:m, :m] @ own + (self.powers[:m] @ (self.weights * z)).real
            z = self.powers[m] * z + self.powers[:m][::-1].T @ own
        return out, z

    def behind(self, m: int, state: np.ndarray, left: np.ndarray) -> np.ndarray:
        return self.poles ** int(m) * state + left


def _flat(z: np.ndarray) -> np.ndarray:
    return np.concatenate([z.real, z.imag])


def _state(flat: list[float]) -> np.ndarray:
    parts = np.asarray(flat, float).reshape(2, -1)
    return parts[0] + 1j * parts[1]


def zero_phase(pieces: DataFrame, b: np.ndarray, a: np.ndarray) -> DataFrame:
    """``pieces`` filtered forward and backward, with odd padding and the steady state at both ends of each recording.

    Three passes over the samples: what a piece leaves of nothing, the forward outputs with what they leave backward, the
    backward outputs. Between them, states are scanned. Recordings of ``3 * len(a)`` samples or fewer are left out.
    """
    move, pad, none = Affine(b, a), 3 * len(a), np.zeros(len(a) - 1)

    def left_behind(row):
        x = row["abp"]
        return {"m": x.size, "c": _flat(move.run(x, none)[1]), "head": x[: pad + 1], "tail": x[-pad - 1 :]}

    small = staged(_mapped(pieces, left_behind, "m long, c array<double>, head array<double>, tail array<double>"), "states")

    def forward(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at")
        if frame["m"].sum() <= pad:
            return pd.DataFrame(columns=["patient_id", "at", "z", "back"])
        first, last = (np.concatenate(list(part)) for part in (frame["head"][: pad + 1], frame["tail"][-pad - 1 :]))
        first, last = first[: pad + 1], last[-pad - 1 :]
        before = 2 * first[0] - first[pad:0:-1]
        z, states = move.run(before, move.steady * before[0])[1], []
        for m, c in zip(frame["m"], frame["c"], strict=True):
            states.append(_flat(z))
            z = move.behind(m, z, _state(c))
        y = move.run(2 * last[-1] - last[-2 : -pad - 2 : -1], z)[0][::-1]
        back = _flat(move.run(y, move.steady * y[0])[1])
        return pd.DataFrame({"patient_id": frame["patient_id"], "at": frame["at"], "z": states, "back": [back] * len(frame)})

    starts = small.groupBy("patient_id").applyInPandas(forward, "patient_id string, at long, z array<double>, back array<double>")

    def onward(row):
        y = move.run(row["abp"], _state(row["z"]))[0]
        return {"abp": y, "m": y.size, "c": _flat(move.run(y[::-1], none)[1]), "back": row["back"]}

    once = staged(_mapped(pieces.join(starts, _KEY), onward, "abp array<double>, m long, c array<double>, back array<double>"), "forward")

    def backward(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at", ascending=False)
        z, states = _state(frame["back"].iloc[0]), []
        for m, c in zip(frame["m"], frame["c"], strict=True):
            states.append(_flat(z))
            z = move.behind(m, z, _state(c))
        return pd.DataFrame({"patient_id": frame["patient_id"], "at": frame["at"], "z": states})

    ends = once.select(*_KEY, "m", "c", "back").groupBy("patient_id").applyInPandas(backward, "patient_id string, at long, z array<double>")
    return _mapped(once.select(*_KEY, "abp").join(ends, _KEY), lambda row: {"abp": move.run(row["abp"][::-1], _state(row["z"]))[0][::-1]}, "abp array<double>")


# ---------------------------------------------------------------- peaks


def lows_back(heights: np.ndarray, lows: np.ndarray) -> np.ndarray:
    """For each place, the least of ``lows`` (the least value since the place before) back to the nearest higher place."""
    out, held = np.empty(len(heights)), []
    for k, (top, low) in enumerate(zip(heights.tolist(), lows.tolist(), strict=True)):
        while held and held[-1][0] <= top:
            low = min(low, held.pop()[1])
        out[k] = low
        held.append((top, low))
    return out


def bases(heights: np.ndarray, lows: np.ndarray) -> np.ndarray:
    """The higher of both sides' lows; ``lows`` holds one more number, for what lies behind the last place."""
    return np.maximum(lows_back(heights, lows[:-1]), lows_back(heights[::-1], lows[:0:-1])[::-1])


def spaced(at: np.ndarray, heights: np.ndarray, distance: int) -> np.ndarray:
    """Which places stay when the highest first (of ties the later) drops all nearer than ``distance``."""
    keep = np.ones(at.size, bool)
    for k in np.argsort(heights, kind="stable")[::-1].tolist():
        if keep[k]:
            low, high = np.searchsorted(at, [at[k] - distance + 1, at[k] + distance])
            keep[low:high] = False
            keep[k] = True
    return keep


def _tops(pieces: DataFrame) -> DataFrame:
    """``patient_id, edge, mid, height, low``: middles of plateaus that are risen to and fallen from, where they fall.

    ``edge`` orders them (twice the number of the first lower sample); ``low`` is the least value since the last row. A
    piece ends with a row without ``mid``, of height minus infinity, for the least value behind its last top.
    """

    def ends(row):
        x = row["abp"]
        steps = np.flatnonzero(np.diff(x) != 0)
        k = int(steps[-1]) if steps.size else None
        return {"first": float(x[0]), "last": float(x[-1]), "rise": None if k is None else float(np.sign(x[k + 1] - x[k])), "start": None if k is None else row["at"] + k + 1}

    small = staged(_mapped(pieces, ends, "first double, last double, rise double, start long"), "ends")

    def carried(frame: pd.DataFrame) -> pd.DataFrame:
        frame, out, held = frame.sort_values("at"), [], None
        for r in frame.itertuples():
            out.append((r.patient_id, r.at, *(held or (None, None, None))))
            if not pd.isna(r.rise):
                held = (r.last, r.rise, int(r.start))
            elif held is None:
                held = (r.first, 0.0, r.at)
            elif r.first != held[0]:
                held = (r.first, float(np.sign(r.first - held[0])), r.at)
        return pd.DataFrame(out, columns=["patient_id", "at", "value", "rise", "start"]).astype({"value": float, "rise": float, "start": "Int64"})

    met = small.groupBy("patient_id").applyInPandas(carried, "patient_id string, at long, value double, rise double, start long")

    def find(row):
        x, at = row["abp"], row["at"]
        before = row["value"] is not None and row["value"] == row["value"]
        wide = np.concatenate([[row["value"]], x]) if before else x
        base = at - 1 if before else at
        steps = np.flatnonzero(np.diff(wide) != 0)
        rise = np.sign(np.diff(wide)[steps])
        came = np.concatenate([[row["rise"] if before else 0.0], rise[:-1]])
        began = np.concatenate([[row["start"] if before else at], base + steps[:-1] + 1]).astype(np.int64)
        top = np.flatnonzero((came > 0) & (rise < 0)) if steps.size else np.empty(0, int)
        edge = base + steps[top] + 1
        mid = (began[top] + edge - 1) // 2
        cuts = np.concatenate([[0], edge - at, [x.size]])
        lows = [float(x[i:j].min()) if j > i else np.inf for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        return {"edge": np.append(2 * edge, 2 * (at + x.size - 1) + 1), "mid": np.append(mid, -1), "height": np.append(wide[steps[top]], -np.inf), "low": lows}

    rows = _mapped(pieces.join(met, _KEY), find, "edge array<long>, mid array<long>, height array<double>, low array<double>")
    return rows.select("patient_id", F.explode(F.arrays_zip("edge", "mid", "height", "low")).alias("t")).select("patient_id", "t.*")


def peaks(pieces: DataFrame, distance: int = DISTANCE, prominence: float = PROMINENCE) -> DataFrame:
    """``patient_id, peak, height``: the peaks that ``signal.peaks`` finds in the whole recordings, at any cut.

    A top that no higher one is near to is a leader: it stays, and parts what is before it from what is behind. Blocks of
    ``LEADERS`` leaders are solved by themselves. Of a block only tops that none in it passes on one side can have their
    base outside; these few meet, and a stack over them gives both sides' bases.
    """
    tops = staged(_tops(pieces), "tops")
    bucket = lambda c: F.floor(c / BUCKET).cast("long")
    near = F.array_distinct(F.array(*(bucket(F.col("mid") + s) for s in (1 - distance, 0, distance - 1))))
    copies = tops.where("mid >= 0").select("patient_id", "mid", "height", F.explode(near).alias("bucket"))
    around = Window.partitionBy("patient_id", "bucket").orderBy("mid").rangeBetween(1 - distance, distance - 1)
    led = copies.withColumn("_best", F.max(F.struct("height", "mid")).over(around)).where((F.col("bucket") == bucket(F.col("mid"))) & (F.col("_best.mid") == F.col("mid")))
    marked = tops.join(led.select("patient_id", "mid", F.lit(1).alias("leader")), ["patient_id", "mid"], "left")
    counted = running(marked, "patient_id", ["edge"], {"_led": Running("sum", F.coalesce("leader", F.lit(0)).cast("long"))})
    block = F.floor(F.col("_led") / LEADERS).cast("long")
    # The leader that opens a block also drops what is near to it in the one before.
    opens = (F.col("leader") == 1) & (F.col("_led") % LEADERS == 0)
    dealt = counted.select("patient_id", "edge", "mid", "height", "low", F.explode(F.when(opens, F.array(block, block - 1)).otherwise(F.array(block))).alias("block"), block.alias("_own"))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("edge")
        real = frame["mid"].to_numpy() >= 0
        keep = np.zeros(len(frame), bool)
        keep[real] = spaced(frame["mid"].to_numpy()[real], frame["height"].to_numpy()[real], distance)
        own = (frame["block"] == frame["_own"]).to_numpy()
        frame, keep = frame[own], keep[own]
        if frame.empty:
            return pd.DataFrame(columns=["patient_id", "edge", "mid", "height", "low", "keep", "open", "base"])
        h, low = frame["height"].to_numpy(), frame["low"].to_numpy()
        left, right = (g >= np.maximum.accumulate(g) for g in (h, h[::-1]))
        open_ = left | right[::-1]
        here = np.flatnonzero(open_)
        merged = low.copy()
        merged[here] = np.minimum.reduceat(low, np.concatenate([[0], here[:-1] + 1]))
        base = bases(h, np.append(low, np.inf))
        wanted = open_ | keep
        return pd.DataFrame({"patient_id": frame["patient_id"], "edge": frame["edge"], "mid": frame["mid"], "height": h, "low": merged, "keep": keep, "open": open_, "base": base})[wanted]

    solved = staged(dealt.groupBy("patient_id", "block").applyInPandas(solve, "patient_id string, edge long, mid long, height double, low double, keep boolean, open boolean, base double"), "solved")

    def met(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("edge")
        base = bases(frame["height"].to_numpy(), np.append(frame["low"].to_numpy(), np.inf))
        return pd.DataFrame({"patient_id": frame["patient_id"], "mid": frame["mid"], "height": frame["height"], "keep": frame["keep"], "base": base})

    between = solved.where("open").groupBy("patient_id").applyInPandas(met, "patient_id string, mid long, height double, keep boolean, base double")
    every = solved.where("not open").select("patient_id", "mid", "height", "keep", "base").unionByName(between)
    return every.where(F.col("keep") & (F.col("height") - F.col("base") >= prominence)).select("patient_id", F.col("mid").alias("peak"), "height")


def systolic_peaks(pieces: DataFrame, fs: float = FS) -> DataFrame:
    """``patient_id, peak, height``: gaps filled, standardised, band-passed, standardised again, and its peaks."""
    ready = staged(standard(staged(filled(pieces), "filled")), "standard")
    passed = staged(zero_phase(ready, *band_pass(fs=fs)), "passed")
    return peaks(staged(standard(passed), "passed"))

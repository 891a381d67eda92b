"""Odd and even representatives kept up to date over a stream of beats, with keyed state.

State of a patient: a count and a sum of shapes for each open block, and the sums of the shapes of closed blocks, of all and
of the odd ones; never a beat. A timer at each block's end closes it, once the watermark has passed: a block with enough
beats adds its normalised mean shape, and the patient's representatives are emitted anew (``n_blocks`` grows with each row of a
patient, so that the last one amends those before). A stream whose blocks are all closed gives the rows of the batch
operators ``central_shape`` and ``replicates``. Beats of a closed block come too late and are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROWS = "patient string, n_blocks long, n_odd long, n_even long, all_rep array<double>, odd_rep array<double>, even_rep array<double>"


def _normalised(v: np.ndarray) -> np.ndarray | None:
    v = v - v.mean()
    sd = v.std()
    return v / sd if np.isfinite(sd) and sd > 1e-12 else None


class Replicates(StatefulProcessor):
    """Rows (``patient, at, shape``), ``at`` in event time; blocks of ``width`` seconds are numbered from 1970."""

    def __init__(self, width: int, least_beats: int, least: int, least_half: int):
        self.width, self.least_beats, self.least, self.least_half = width * 1000, least_beats, least, least_half

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "block long", "n long, total array<double>")
        self.closed = handle.getValueState("closed", "n long, odd long, total array<double>, odd_total array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sums: dict[int, list] = {}
        for frame in rows:
            for block, shape in zip((frame["at"].astype("int64") // _unit(frame["at"]) // self.width).tolist(), frame["shape"], strict=True):
                own = sums.setdefault(block, [0, 0.0])
                own[0] += 1
                own[1] = own[1] + np.asarray(shape, float)
        for block, (n, total) in sums.items():
            if self.open.containsKey((block,)):
                before = self.open.getValue((block,))
                n, total = n + before[0], total + np.asarray(before[1], float)
            else:
                self.handle.registerTimer((block + 1) * self.width)
            self.open.updateValue((block,), (n, total.tolist()))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        block = expiredTimerInfo.getExpiryTimeInMs() // self.width - 1
        n, total = self.open.getValue((block,))
        self.open.removeKey((block,))
        q = _normalised(np.asarray(total, float) / n) if n >= self.least_beats else None
        if q is None:
            return
        blocks, odd, total, odd_total = self.closed.get() if self.closed.exists() else (0, 0, np.zeros(q.size), np.zeros(q.size))
        is_odd = block % 2 == 1
        blocks, odd = blocks + 1, odd + is_odd
        total, odd_total = np.asarray(total, float) + q, np.asarray(odd_total, float) + (q if is_odd else 0)
        self.closed.update((blocks, int(odd), total.tolist(), odd_total.tolist()))
        if blocks >= self.least and odd >= self.least_half and blocks - odd >= self.least_half:
            reps = [_normalised(v) for v in (total, odd_total, total - odd_total)]
            yield pd.DataFrame([(key[0], blocks, int(odd), int(blocks - odd), *(None if r is None else r.tolist() for r in reps))], columns=[c.split()[0] for c in ROWS.split(", ")])

    def close(self) -> None:
        pass


def _unit(column: pd.Series) -> int:
    """Units of a timestamp column in a millisecond."""
    return {"ns": 1_000_000, "us": 1000, "ms": 1}[np.datetime_data(column.dtype.base if hasattr(column.dtype, "base") else column.dtype)[0]]


def replicate_stream(beats: DataFrame, *, width: int = 60, least_beats: int = 32, least: int = 6, least_half: int = 3, late: str = "2 minutes") -> DataFrame:
    """The representatives of a stream of beats (``patient`` string, ``at`` timestamp, ``shape`` array of doubles)."""
    beats.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = beats.where("shape is not null and at is not null").withWatermark("at", late)
    return rows.groupBy("patient").transformWithStateInPandas(statefulProcessor=Replicates(width, least_beats, least, least_half), outputStructType=ROWS, outputMode="Update", timeMode="EventTime")


def finished(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run the stream over what there is, from where ``checkpoint`` left it, append to a Parquet folder, and give the last
    row of each patient."""

    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(append).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema(f"{ROWS}, batch long").parquet(path)
    last = found.groupBy("patient").agg(F.max_by(F.struct(*(c.split()[0] for c in ROWS.split(", "))), "n_blocks").alias("r"))
    return last.select("r.*")

"""Blocks of beats over a stream: an extension, with the rows of the batch operator once a block is closed.

Beats that come after the watermark has passed their block are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_summaries(beats: DataFrame, *, patient: str = "user_id", time: str = "ts", value: str = "value", width: str = "60 seconds", late: str = "2 minutes") -> DataFrame:
    """``patient, start, n_beats, mean_value`` of tumbling blocks, for a batch or (with a watermark) a stream."""
    rows = beats.withColumn(time, F.col(time).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark(time, late)
    out = rows.groupBy(patient, F.window(time, width).alias("w")).agg(F.count("*").alias("n_beats"), F.avg(value).alias("mean_value"))
    return out.select(patient, F.col("w.start").alias("start"), "n_beats", "mean_value")


def write_blocks(stream: DataFrame, path: str, checkpoint: str):
    """Start a query that appends closed blocks to a Parquet folder; survives restarts by its checkpoint."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""The driver tables in the roles that the operators need, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import linkage


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def shapes(spark: SparkSession, d: str) -> DataFrame:
    """Block shapes: a hundred patients, their blocks numbered from 0."""
    e = table(spark, d, "embeddings")
    return e.select("vec_id", (F.col("vec_id") % 100).alias("patient"), F.expr("vec_id div 100").alias("block"), "label", V.doubles(F.col("embedding")).alias("v"))


def beats(spark: SparkSession, d: str) -> DataFrame:
    """Beats: a user's events, placed in seconds from the user's first, with a value."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    first = e.groupBy("user_id").agg(F.min("at").alias("first"))
    return e.join(first, "user_id").select("event_id", "user_id", "event_type", "value", (F.col("at") - F.col("first")).alias("center"))


def intervals(spark: SparkSession, d: str) -> DataFrame:
    """Stays: 180 days from each order's date."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("interval_id"), F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.expr("INTERVAL 180 DAYS")).alias("stop"), (F.col("o_orderstatus") == "F").cast("int").alias("flag"), "o_totalprice")


def probes(spark: SparkSession, d: str) -> DataFrame:
    """One moment a customer: the middle ship date of its lines."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    owned = lines.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return linkage.middle_row(owned, "o_custkey", ["l_shipdate", "l_orderkey", "l_linenumber"]).select(F.col("o_custkey").alias("subject"), F.col("l_shipdate").alias("t"))


def codes(spark: SparkSession, d: str) -> DataFrame:
    """Diagnoses: a code for each line, its number as the sequence."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat((390 + F.col("p_partkey") % 120).cast("string"), (F.col("p_size") % 10).cast("string")).alias("code"))
    return lines.join(parts, "l_partkey").select(F.col("l_orderkey").alias("interval_id"), F.col("l_linenumber").alias("seq"), "code")


#: The same in SQL, as parts of a WITH clause.


def pressures(spark, d):
    """Waveforms of a hundred beats a patient, each beat's length, height and dicrotic wave from one vector; the recordings
    of every fifth patient are flat, and of every seventh at another rate."""
    e = table(spark, d, "embeddings").where("embedding is not null").select((F.expr("vec_id div 100")).alias("p"), "vec_id", *(F.coalesce(F.get("embedding", F.lit(k)), F.lit(0.0)).cast("double").alias(c) for k, c in enumerate("abc")))
    n = (F.lit(95) + F.least(F.greatest(F.col("a"), F.lit(-1.0)), F.lit(1.0)) * 40).cast("int")
    bump = lambda x, at, wide: F.exp(-((x - at) / wide) * ((x - at) / wide))
    beat = F.transform(F.sequence(F.lit(0), n - 1), lambda i: 80 + (40 + 30 * F.col("b")) * bump(i / n, 0.3, 0.12) + (9 + 20 * F.col("c")) * bump(i / n, 0.62, 0.1))
    ordered = F.sort_array(F.collect_list(F.struct("vec_id", beat.alias("x"))))
    abp = F.flatten(F.transform(ordered, lambda b: b["x"]))
    made = e.groupBy("p").agg(abp.alias("abp"))
    flat = F.when(F.col("p") % 5 == 4, F.transform("abp", lambda x: F.lit(80.0))).otherwise(F.col("abp"))
    return made.select(F.concat(F.lit("p"), F.col("p").cast("string")).alias("patient_id"), F.when(F.col("p") % 7 == 6, 100.0).otherwise(125.0).alias("fs"), flat.alias("abp"))


SHAPES = "e AS (SELECT vec_id, vec_id % 100 AS patient, vec_id // 100 AS block, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
LONG = SHAPES + ", l AS (SELECT vec_id, patient, block, label, unnest(range(0, len(v))) AS pos, unnest(v) AS x FROM e)"
NORMALISED = (
    LONG
    + ", m AS (SELECT vec_id, avg(x) AS mu, stddev_pop(x) AS sd, count(*) AS n FROM l GROUP BY vec_id)"
    + ", q AS (SELECT l.vec_id, patient, block, label, pos, (x - mu) / sd AS x FROM l JOIN m USING (vec_id) WHERE n = 64 AND sd > 1e-12)"
)
REPS = (
    NORMALISED
    + ", c AS (SELECT patient, count(DISTINCT block) AS n_blocks, count(DISTINCT block) FILTER (block % 2 = 1) AS n_odd, count(DISTINCT block) FILTER (block % 2 = 0) AS n_even FROM q GROUP BY patient)"
    + ", r0 AS (SELECT patient, pos, avg(x) AS a, avg(x) FILTER (block % 2 = 1) AS o, avg(x) FILTER (block % 2 = 0) AS e FROM q GROUP BY patient, pos)"
    + ", r1 AS (SELECT patient, avg(a) ma, stddev_pop(a) sa, avg(o) mo, stddev_pop(o) so, avg(e) me, stddev_pop(e) se FROM r0 GROUP BY patient)"
    + ", r AS (SELECT patient, pos, (a - ma) / sa AS a, (o - mo) / so AS o, (e - me) / se AS e FROM r0 JOIN r1 USING (patient) JOIN c USING (patient) WHERE n_blocks >= 4 AND n_odd >= 2 AND n_even >= 2)"
)
BEATS = "b AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6 - min(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id) AS center FROM events)"
INTERVALS = "iv AS (SELECT o_custkey AS subject, o_orderkey AS interval_id, o_orderdate AS start, o_orderdate + INTERVAL 180 DAY AS stop, (o_orderstatus = 'F')::INT AS flag, o_totalprice FROM orders)"
PROBES = (
    "pr AS (SELECT o_custkey AS subject, l_shipdate AS t FROM (SELECT o_custkey, l_shipdate, row_number() OVER (PARTITION BY o_custkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS k, "
    "count(*) OVER (PARTITION BY o_custkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE k = (n + 1) // 2)"
)
CODES = "dx AS (SELECT l_orderkey AS interval_id, l_linenumber AS seq, (390 + p_partkey % 120)::VARCHAR || (p_size % 10)::VARCHAR AS code FROM lineitem JOIN part ON l_partkey = p_partkey)"

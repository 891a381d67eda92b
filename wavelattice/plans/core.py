"""Queries of shapes, blocks, covariance, linkage, flags and guards, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vectors as V
from ..operators import blocks, covariance, guards, linkage, summaries
from .tables import BEATS, CODES, INTERVALS, LONG, NORMALISED, PROBES, REPS, SHAPES, beats, codes, intervals, probes, shapes, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with SQL that gives the same rows."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, -0.0 as 0.0, so that sums in any order compare equal."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def replicate_shapes(spark: SparkSession, d: str) -> DataFrame:
    normal = shapes(spark, d).withColumn("q", V.normalised(F.col("v")))
    return blocks.replicates(normal, "patient", "block", "q", least=4, least_half=2)


# ---------------------------------------------------------------- shapes and blocks


@query(f"WITH {SHAPES}, s AS (SELECT vec_id, v, list_avg(v) AS mu, list_stddev_pop(v) AS sd FROM e) SELECT vec_id, round(mu, 6) + 0.0 AS mean, round(sd, 6) AS sd, CASE WHEN len(v) = 64 AND sd > 1e-12 THEN round((v[1] - mu) / sd, 6) + 0.0 END AS first, CASE WHEN len(v) = 64 AND sd > 1e-12 THEN round((v[64] - mu) / sd, 6) + 0.0 END AS last FROM s")
def shape_normalize(spark, d):
    e = shapes(spark, d)
    q = e.withColumn("q", V.normalised(F.col("v")))
    return rounded(q.select("vec_id", V.mean(F.col("v")).alias("mean"), V.population_sd(F.col("v")).alias("sd"), F.get("q", F.lit(0)).alias("first"), F.get("q", F.lit(63)).alias("last")))


_REPLICATES = f"WITH {REPS} SELECT patient, n_blocks, n_odd, n_even, round(max(a), 6) AS top_all, round(max(o), 6) AS top_odd, round(max(e), 6) AS top_even, round(sum(o * e) / 64, 6) + 0.0 AS agreement FROM r JOIN c USING (patient) GROUP BY patient, n_blocks, n_odd, n_even"


@query(_REPLICATES)
def block_replicates(spark, d):
    r = replicate_shapes(spark, d)
    return rounded(r.select("patient", "n_blocks", "n_odd", "n_even", F.array_max("all_rep").alias("top_all"), F.array_max("odd_rep").alias("top_odd"), F.array_max("even_rep").alias("top_even"), (V.dot(F.col("odd_rep"), F.col("even_rep")) / 64).alias("agreement")))


@query(_REPLICATES)
def stream_replicates(spark, d):
    """The same from a stream with keyed state: blocks close by the clock of the blocks, a last row moves it on."""
    from ..sources.shared import scratch
    from ..streaming import replicates

    # As a pattern, since a stream's plain path has to be a folder.
    raw = spark.readStream.schema(table(spark, d, "embeddings").schema).parquet(f"{d}/embeddings.parque[t]")
    seconds = F.expr("vec_id div 100") * 60 + 1
    beat = F.struct((F.col("vec_id") % 100).cast("string").alias("patient"), F.timestamp_seconds(seconds).alias("at"), V.doubles(F.col("embedding")).alias("shape"))
    last = F.when(F.col("vec_id") == 0, F.struct(F.lit("end").alias("patient"), F.lit("2200-01-01").cast("timestamp").alias("at"), V.doubles(F.col("embedding")).alias("shape")))
    beats = raw.select(F.explode(F.array_compact(F.array(beat, last))).alias("b")).select("b.*")
    stream = replicates.replicate_stream(beats, width=60, least_beats=1, least=4, least_half=2)
    found = replicates.finished(spark, stream, scratch(spark, "replicates"), scratch(spark, "stream-state"))
    agreement = F.aggregate(F.zip_with("odd_rep", "even_rep", lambda o, e: o * e), F.lit(0.0), lambda t, x: t + x) / 64
    tops = (F.array_max(f"{k}_rep").alias(f"top_{k}") for k in ("all", "odd", "even"))
    return rounded(found.select(F.col("patient").cast("long").alias("patient"), *(F.col(c) for c in ("n_blocks", "n_odd", "n_even")), *tops, agreement.alias("agreement")))


@query(f"WITH {NORMALISED}, g AS (SELECT label, pos, avg(x) AS x, count(*) AS n FROM q GROUP BY label, pos) SELECT label, n, round(stddev_pop(x), 6) AS kappa FROM g GROUP BY label, n")
def block_coherence(spark, d):
    normal = shapes(spark, d).withColumn("q", V.normalised(F.col("v")))
    return rounded(blocks.central_shape(normal, ["label"], "q").select("label", "n", "kappa"))


@query(f"WITH {LONG} SELECT a.pos::INT AS i, b.pos::INT AS j, round(covar_samp(a.x, b.x), 8) + 0.0 AS c FROM l a JOIN l b USING (vec_id) GROUP BY a.pos, b.pos")
def cov_matrix_64(spark, d):
    return rounded(covariance.covariance(shapes(spark, d), "v"), 8)


@query(f"WITH {REPS}, x AS (SELECT a.pos AS i, b.pos AS j, covar_samp(a.o, b.e) AS c FROM r a JOIN r b USING (patient) GROUP BY a.pos, b.pos) SELECT x.i::INT AS i, x.j::INT AS j, round((x.c + y.c) / 2, 6) + 0.0 AS c FROM x JOIN x y ON x.i = y.j AND x.j = y.i")
def cross_cov_sym_64(spark, d):
    return rounded(covariance.symmetric_cross_covariance(replicate_shapes(spark, d), "odd_rep", "even_rep"))


@query(f"WITH {LONG}, w AS (SELECT a.patient, a.pos AS i, b.pos AS j, covar_samp(a.x, b.x) AS c FROM l a JOIN l b USING (vec_id) GROUP BY a.patient, a.pos, b.pos) SELECT i::INT AS i, j::INT AS j, round(avg(c), 8) + 0.0 AS c FROM w GROUP BY i, j")
def within_cov_mean(spark, d):
    return rounded(covariance.mean_within_covariance(shapes(spark, d), "patient", "v"), 8)


@query(f"WITH {LONG}, s AS (SELECT vec_id, patient, block, list(x ORDER BY pos) AS v FROM l GROUP BY vec_id, patient, block), w AS (SELECT patient, block, v, lag(v) OVER p AS u, lag(block) OVER p AS last FROM s WINDOW p AS (PARTITION BY patient ORDER BY block)) SELECT patient, block, round(sqrt(list_sum(list_transform(list_zip(v, u), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS step FROM w WHERE block = last + 1")
def adjacent_step(spark, d):
    return rounded(blocks.adjacent_steps(shapes(spark, d), "patient", "block", "v"))


_BLOCK = "CASE WHEN center >= 0 AND center <= 86400.0 * 30 THEN least(floor(center / 86400.0), 29)::INT END"


@query(f"WITH {BEATS}, k AS (SELECT user_id, value, {_BLOCK} AS block FROM b) SELECT user_id, block, count(*) AS n_beats, round(avg(value), 6) AS mean_value FROM k WHERE block IS NOT NULL GROUP BY user_id, block")
def tumbling_blocks(spark, d):
    b = beats(spark, d).withColumn("block", blocks.tumbling_block(F.col("center"), F.lit(0.0), 86_400.0))
    return rounded(b.where("block is not null").groupBy("user_id", "block").agg(F.count("*").alias("n_beats"), F.avg("value").alias("mean_value")))


@query(
    f"WITH {BEATS}, k0 AS (SELECT user_id, {_BLOCK} AS block FROM b), k AS (SELECT user_id, block, count(*) AS n FROM k0 WHERE block IS NOT NULL GROUP BY user_id, block), t AS (SELECT unnest([1, 2, 3, 4, 6])::INT AS threshold), "
    "g AS (SELECT threshold, user_id, count(*) FILTER (n >= threshold) AS total, count(*) FILTER (n >= threshold AND block % 2 = 1) AS odd, count(*) FILTER (n >= threshold AND block % 2 = 0) AS even FROM k CROSS JOIN t GROUP BY threshold, user_id) "
    "SELECT threshold, count(*) AS n_patients, count(*) FILTER (total >= 6 AND odd >= 3 AND even >= 3) AS n_usable, min(total) AS min_total, median(total) AS median_total, max(total) AS max_total FROM g GROUP BY threshold"
)
def block_yield_table(spark, d):
    counted = tumbling_blocks(spark, d).select("user_id", "block", F.col("n_beats").alias("n"))
    return blocks.yield_table(counted, "user_id", "block", "n", [1, 2, 3, 4, 6], least=6, least_half=3)


@query(
    "WITH m AS (SELECT user_id, median(value) AS mid FROM events GROUP BY user_id), k AS (SELECT user_id, median(abs(value - mid)) AS mad FROM events JOIN m USING (user_id) GROUP BY user_id) "
    "SELECT user_id, count(*) AS n, count(*) FILTER (mad <= 1e-12 OR abs(value - mid) <= 2.0 * 1.4826 * mad) AS n_kept FROM events JOIN m USING (user_id) JOIN k USING (user_id) GROUP BY user_id"
)
def mad_qc(spark, d):
    kept = blocks.deviation_kept(table(spark, d, "events").select("user_id", "value"), ["user_id"], "value", "kept", width=2.0)
    return kept.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("kept").alias("n_kept"))


@query(
    f"WITH {LONG}, t AS (SELECT label, pos, median(x) AS y FROM l GROUP BY label, pos), k AS (SELECT vec_id, l.label, corr(x, y) AS r FROM l JOIN t ON l.label = t.label AND l.pos = t.pos GROUP BY vec_id, l.label) "
    "SELECT label, count(*) AS n, count(*) FILTER (r >= 0.1) AS n_kept, round(avg(r), 6) AS mean_correlation FROM k GROUP BY label"
)
def template_corr_qc(spark, d):
    k = blocks.template_correlation(shapes(spark, d), ["label"], "v")
    return rounded(k.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("correlation") >= 0.1).alias("n_kept"), F.avg("correlation").alias("mean_correlation")))


@query("SELECT fold::INT AS fold, count(*) AS n FROM (SELECT ('0x' || substr(sha256('20260820:' || c_name), 1, 16))::UBIGINT % 5 AS fold FROM customer) GROUP BY fold")
def stable_fold_counts(spark, d):
    return table(spark, d, "customer").groupBy(S.stable_fold(F.col("c_name")).alias("fold")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- linkage


@query(f"WITH {INTERVALS}, {PROBES} SELECT pr.subject, count(interval_id) AS n_exact, CASE WHEN count(interval_id) = 1 THEN max(interval_id) END AS exact_id FROM pr LEFT JOIN iv ON pr.subject = iv.subject AND t BETWEEN start AND stop GROUP BY pr.subject")
def interval_containment(spark, d):
    return linkage.containment(probes(spark, d), intervals(spark, d), "subject", probe_id="subject")


_NEAREST = (
    f"{INTERVALS}, {PROBES}, g AS (SELECT pr.subject, interval_id, t, start, stop, CASE WHEN t < start THEN epoch(start - t) / 3600.0 WHEN t > stop THEN epoch(t - stop) / 3600.0 WHEN interval_id IS NOT NULL THEN 0.0 END AS gap FROM pr LEFT JOIN iv USING (subject)), "
    "n AS (SELECT *, min(gap) OVER p AS least, row_number() OVER (PARTITION BY subject ORDER BY gap, interval_id) AS k FROM g WINDOW p AS (PARTITION BY subject)), "
    "near AS (SELECT subject, gap AS gap_h, CASE WHEN gap IS NULL THEN 'missing' WHEN t < start THEN 'before_start' WHEN t > stop THEN 'after_end' ELSE 'inside' END AS direction, (SELECT count(*) FROM n o WHERE o.subject = n.subject AND abs(o.gap - n.least) < 1e-12) AS ties, interval_id AS nearest_id FROM n WHERE k = 1)"
)


@query(f"WITH {_NEAREST} SELECT subject, round(gap_h, 6) AS gap_h, direction, ties, nearest_id FROM near")
def nearest_interval(spark, d):
    return rounded(linkage.nearest(probes(spark, d), intervals(spark, d), "subject", probe_id="subject"))


@query(f"WITH {INTERVALS}, {PROBES} SELECT pr.subject, count(stop) AS n_prior, max(flag) AS prior_flag FROM pr LEFT JOIN iv ON pr.subject = iv.subject AND stop < t GROUP BY pr.subject")
def prior_history(spark, d):
    return linkage.prior_history(probes(spark, d), intervals(spark, d), "subject", probe_id="subject", flag="flag")


@query(
    f"WITH {INTERVALS}, {PROBES}, a AS (SELECT pr.subject, CASE WHEN count(interval_id) = 1 THEN max(interval_id) END AS x FROM pr LEFT JOIN iv ON pr.subject = iv.subject AND t BETWEEN start AND stop AND flag = 1 GROUP BY pr.subject), "
    "b AS (SELECT pr.subject, CASE WHEN count(interval_id) = 1 THEN max(interval_id) END AS y FROM pr LEFT JOIN iv ON pr.subject = iv.subject AND t BETWEEN start AND stop GROUP BY pr.subject) "
    "SELECT subject, coalesce(x, y) AS link_id, CASE WHEN x IS NOT NULL THEN 'first' WHEN y IS NOT NULL THEN 'second' ELSE 'none' END AS via FROM a JOIN b USING (subject)"
)
def preference_chain_link(spark, d):
    p, i = probes(spark, d), intervals(spark, d)
    a = linkage.containment(p, i.where("flag = 1"), "subject", probe_id="subject")
    return linkage.preferred_link(a, linkage.containment(p, i, "subject", probe_id="subject"), "subject")


@query(f"WITH {_NEAREST}, h AS (SELECT unnest([1.0, 6.0, 12.0, 24.0, 48.0, 72.0, 168.0, 2400.0])::DOUBLE AS threshold) SELECT threshold, count(*) FILTER (gap_h <= threshold) AS n_within, count(gap_h) AS n_known FROM near CROSS JOIN h GROUP BY threshold")
def gap_threshold_sweep(spark, d):
    near = linkage.nearest(probes(spark, d), intervals(spark, d), "subject", probe_id="subject")
    return linkage.threshold_sweep(near, "gap_h", [1, 6, 12, 24, 48, 72, 168, 2400])


@query(
    f"WITH {INTERVALS}, {PROBES}, k AS (SELECT pr.subject, count(interval_id) AS n, count(interval_id) FILTER (flag = 1) AS f FROM pr LEFT JOIN iv ON pr.subject = iv.subject AND t BETWEEN start AND stop GROUP BY pr.subject) "
    'SELECT count(*) FILTER (n = 1 AND f = 1) AS "both", count(*) FILTER (n = 1 AND f <> 1) AS only_first, count(*) FILTER (n <> 1 AND f = 1) AS only_second, count(*) FILTER (n <> 1 AND f <> 1) AS neither FROM k'
)
def linkage_crosstab(spark, d):
    p, i = probes(spark, d), intervals(spark, d)
    a = linkage.containment(p, i, "subject", probe_id="subject").select("subject", F.col("n_exact").alias("n"))
    b = linkage.containment(p, i.where("flag = 1"), "subject", probe_id="subject").select("subject", F.col("n_exact").alias("f"))
    return linkage.crosstab(a.join(b, "subject"), F.col("n") == 1, F.col("f") == 1)


_HOT = (
    "pr AS (SELECT l_orderkey AS probe, o_custkey % 3 AS subject, l_shipdate AS t FROM (SELECT l_orderkey, min(l_shipdate) AS l_shipdate FROM lineitem GROUP BY l_orderkey) JOIN orders ON o_orderkey = l_orderkey), "
    "iv AS (SELECT o_custkey % 3 AS subject, o_orderkey AS interval_id, o_orderdate AS start, o_orderdate + INTERVAL 9 HOURS AS stop, (o_orderstatus = 'F')::INT AS flag FROM orders), "
    "j AS (SELECT probe, interval_id, flag, t, start, stop, CASE WHEN t < start THEN epoch(start - t) / 3600.0 WHEN t > stop THEN epoch(t - stop) / 3600.0 ELSE 0.0 END AS gap FROM pr JOIN iv USING (subject)), "
    "m AS (SELECT probe, count(*) FILTER (gap = 0) AS n_exact, CASE WHEN count(*) FILTER (gap = 0) = 1 THEN max(interval_id) FILTER (gap = 0) END AS exact_id, count(*) FILTER (stop < t) AS n_prior, max(flag) FILTER (stop < t) AS prior_flag, min(gap) AS gap_h, arg_min(interval_id, (gap, interval_id)) AS nearest_id FROM j GROUP BY probe), "
    "k AS (SELECT j.probe, count(*) AS ties FROM j JOIN m ON m.probe = j.probe AND j.gap = m.gap_h GROUP BY j.probe)"
)


@query(f"WITH {_HOT} SELECT m.probe, n_exact, exact_id, n_prior, prior_flag, round(gap_h, 6) AS gap_h, ties, nearest_id FROM m JOIN k USING (probe)")
def hot_subject_links(spark, d):
    """Three subjects hold all intervals and all moments, so that every subject is spread over many tasks."""
    o = table(spark, d, "orders")
    first = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("t"))
    p = first.join(o, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("l_orderkey").alias("probe"), (F.col("o_custkey") % 3).alias("subject"), "t")
    i = o.select((F.col("o_custkey") % 3).alias("subject"), F.col("o_orderkey").alias("interval_id"), F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.expr("INTERVAL 9 HOURS")).alias("stop"), (F.col("o_orderstatus") == "F").cast("int").alias("flag"))
    return rounded(linkage.links(p, i, "subject", probe_id="probe", flag="flag").drop("direction"))


# ---------------------------------------------------------------- identifiers, ages, records


@query("SELECT c_custkey, CASE WHEN age > 89 THEN 90.0 WHEN age >= 0 THEN age END AS age_years, CASE WHEN age IS NOT NULL THEN (age > 89)::INT END AS age_90plus FROM (SELECT c_custkey, c_acctbal / 100 AS age FROM customer)")
def age_topcode(spark, d):
    age = F.col("c_acctbal") / 100
    return table(spark, d, "customer").select("c_custkey", S.top_coded_age(age).alias("age_years"), (age > 89).cast("int").alias("age_90plus"))


@query("SELECT c_custkey, try_cast(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) AS trailing_id, try_cast(regexp_replace(c_name || '-' || c_nationkey, '[^0-9]', '', 'g') AS BIGINT) AS digits_id FROM customer")
def subject_id_parse(spark, d):
    mixed = F.concat("c_name", F.lit("-"), F.col("c_nationkey").cast("string"))
    return table(spark, d, "customer").select("c_custkey", S.trailing_id(F.col("c_name")).alias("trailing_id"), S.digits_id(mixed).alias("digits_id"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate + to_hours(o_orderkey % 24) END AS started, CASE WHEN o_orderkey % 7 <> 0 THEN round(epoch(o_orderdate + to_hours(o_orderkey % 24) - TIMESTAMP '1990-01-01') / (365.2425 * 86400), 6) END AS age FROM orders")
def record_name_datetime(spark, d):
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd")
    hour = F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0")
    name = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("p1-"), stamp, F.lit("-99-00"))).otherwise(F.concat(F.lit("p"), F.col("o_custkey").cast("string"), F.lit("-"), stamp, F.lit("-"), hour, F.lit("-00")))
    named = table(spark, d, "orders").select("o_orderkey", S.record_time(name).alias("started"))
    return rounded(named.withColumn("age", S.seconds_between(F.expr("timestamp_ntz'1990-01-01'"), F.col("started")) / S.YEAR_SECONDS))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 4 THEN o_orderdate + to_hours(o_orderkey % 24) + to_seconds(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 60 ELSE 0 END) END AS started FROM orders")
def record_start_fallback(spark, d):
    """Times from names, and from the last part of a path where the name is blank or null; others have none."""
    o = F.col("o_orderkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    stamp = F.concat(F.lit("p"), F.col("o_custkey").cast("string"), F.lit("-"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("-"), two(o % 24), F.lit("-00"), F.when(o % 2 == 0, F.concat(F.lit("-"), two(o % 60))).otherwise(F.lit("")))
    name = F.when(o % 5 == 0, F.concat(F.lit(" "), stamp, F.lit(" "))).when(o % 5 == 1, F.lit("  ")).when(o % 5 == 4, F.lit("unknown"))
    path = F.when(o % 5 == 0, F.lit("p9/p9-1999-01-01-00-00")).otherwise(F.concat(F.lit("p1/p12/"), stamp, F.when(o % 3 == 0, F.lit("/")).otherwise(F.lit(""))))
    return table(spark, d, "orders").select("o_orderkey", S.record_start(name, path).alias("started"))


# ---------------------------------------------------------------- facts and flags

_HEIGHTS = "h AS (SELECT o_custkey AS subject, p_partkey % 7 AS item, CASE WHEN p_partkey % 7 IN (1, 2, 3, 5) THEN p_size * 2.54 ELSE p_size::DOUBLE END AS cm FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE l_discount = 0 OR l_discount > 0.02)"


def heights(spark, d):
    """Facts: item ids, a unit rule for some of them, an error rule and a range rule."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_partkey") % 7).alias("item"), "p_size")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("subject"))
    facts = table(spark, d, "lineitem").where((F.col("l_discount") == 0) | (F.col("l_discount") > 0.02)).select("l_orderkey", "l_partkey").join(p, "l_partkey").join(o, "l_orderkey")
    return facts.select("subject", "item", F.when(F.col("item").isin(1, 2, 3, 5), F.col("p_size") * 2.54).otherwise(F.col("p_size").cast("double")).alias("cm"))


@query(
    f"WITH {_HEIGHTS} SELECT subject, count(*) AS n, round(median(cm), 6) AS median, round(avg(cm), 6) AS mean, round(min(cm), 6) AS min, round(max(cm), 6) AS max, round(stddev_samp(cm), 6) AS sd, "
    "round(quantile_cont(cm, 0.25), 6) AS q25, round(quantile_cont(cm, 0.75), 6) AS q75, round(quantile_cont(cm, 0.75) - quantile_cont(cm, 0.25), 6) + 0.0 AS iqr FROM h WHERE cm > 10 AND cm <= 100 GROUP BY subject"
)
def height_like_summary(spark, d):
    kept = heights(spark, d).where((F.col("cm") > 10) & (F.col("cm") <= 100))
    return rounded(summaries.group_summary(kept, ["subject"], "cm"))


@query(
    f"WITH {_HEIGHTS}, k AS (SELECT DISTINCT subject FROM h WHERE cm > 120), s AS (SELECT count(*) AS n, count(k.subject) AS n_known FROM customer LEFT JOIN k ON c_custkey = k.subject) "
    "SELECT n, n_known, round(n_known / n, 6) AS share, CASE WHEN n_known / n >= 0.8 THEN 'AUTHORIZE_EXTENDED_CONSTITUTIONAL_MODEL' WHEN n_known / n >= 0.6 THEN 'SECONDARY_COMPLETE_CASE_SENSITIVITY_ONLY' ELSE 'DESCRIPTIVE_AVAILABILITY_ONLY' END AS role FROM s"
)
def coverage_role(spark, d):
    known = heights(spark, d).where("cm > 120").select(F.col("subject").alias("c_custkey")).distinct().withColumn("known", F.lit(1))
    s = table(spark, d, "customer").join(known, "c_custkey", "left").agg(F.count("*").alias("n"), F.count("known").alias("n_known"))
    share = F.col("n_known") / F.col("n")
    return rounded(s.withColumn("share", share).withColumn("role", S.coverage_role(share)))


def _group_sql(name: str) -> str:
    exact, four, three = (", ".join(f"'{c}'" for c in g) or "NULL" for g in S.CODE_GROUPS[name])
    return f"coalesce(code IN ({exact}), false) OR coalesce(substr(code, 1, 4) IN ({four}), false) OR coalesce(substr(code, 1, 3) IN ({three}), false)"


_FLAGS = "fl AS (SELECT interval_id, " + ", ".join(f"max(({_group_sql(g)})::INT) AS {g}" for g in S.CODE_GROUPS) + " FROM dx WHERE seq <> 1 GROUP BY interval_id)"


def code_flag_rows(spark, d):
    secondary = codes(spark, d).where("seq is not null and seq <> 1")
    code = S.clean_code(F.col("code"))
    return summaries.flags_by_key(secondary, ["interval_id"], {g: S.in_group(code, rule) for g, rule in S.CODE_GROUPS.items()})


@query(f"WITH {CODES}, {_FLAGS} SELECT * FROM fl")
def code_flags(spark, d):
    return code_flag_rows(spark, d)


_TRI = (
    f"WITH {CODES}, {_FLAGS}, {INTERVALS}, {PROBES}, ex AS (SELECT pr.subject, CASE WHEN count(interval_id) = 1 THEN max(interval_id) END AS exact_id FROM pr LEFT JOIN iv ON pr.subject = iv.subject AND t BETWEEN start AND stop GROUP BY pr.subject), "
    "pri AS (SELECT pr.subject, coalesce(max(hypertension), 0) AS prior FROM pr LEFT JOIN iv ON pr.subject = iv.subject AND stop < t LEFT JOIN fl ON fl.interval_id = iv.interval_id GROUP BY pr.subject), "
    "tri AS (SELECT ex.subject, pri.prior, CASE WHEN exact_id IS NOT NULL THEN coalesce(hypertension, 0) END AS current FROM ex JOIN pri USING (subject) LEFT JOIN fl ON fl.interval_id = exact_id), "
    "cmb AS (SELECT subject, prior, current, CASE WHEN current IS NOT NULL THEN greatest(prior, current) WHEN prior = 1 THEN 1 END AS combined FROM tri) "
)


def tri_state_rows(spark, d):
    p, i, f = probes(spark, d), intervals(spark, d), code_flag_rows(spark, d).select("interval_id", "hypertension")
    exact = linkage.containment(p, i, "subject", probe_id="subject")
    flagged = i.join(f, "interval_id", "left").withColumn("h", F.coalesce("hypertension", F.lit(0)))
    prior = linkage.prior_history(p, flagged, "subject", probe_id="subject", flag="h").select("subject", F.coalesce("prior_flag", F.lit(0)).alias("prior"))
    current = exact.join(f.withColumnRenamed("interval_id", "exact_id"), "exact_id", "left").select("subject", F.when(F.col("exact_id").isNotNull(), F.coalesce("hypertension", F.lit(0))).alias("current"))
    both = prior.join(current, "subject")
    return both.withColumn("combined", summaries.combined_flag(F.col("prior"), F.col("current")))


@query(_TRI + "SELECT * FROM cmb")
def tri_state_flags(spark, d):
    return tri_state_rows(spark, d).select("subject", "prior", "current", "combined")


_ROLE = "CASE WHEN n_exposed >= 50 AND n_known - n_exposed >= 200 THEN 'MAIN_STAGE7C_CANDIDATE' WHEN n_exposed >= 30 AND n_known - n_exposed >= 200 THEN 'EXPLORATORY_SUPPLEMENT_ONLY' ELSE 'DESCRIPTIVE_PREVALENCE_ONLY' END"


@query(
    _TRI
    + ", u AS (SELECT 'prior' AS flag, count(prior) AS n_known, sum(prior)::BIGINT AS n_exposed FROM cmb UNION ALL SELECT 'current', count(current), sum(current)::BIGINT FROM cmb UNION ALL SELECT 'combined', count(combined), sum(combined)::BIGINT FROM cmb) "
    + f"SELECT flag, n_known, n_exposed, round(n_exposed / n_known, 6) AS rate, {_ROLE} AS role FROM u"
)
def prevalence_roles(spark, d):
    return rounded(summaries.prevalence(tri_state_rows(spark, d), ["prior", "current", "combined"]))


# ---------------------------------------------------------------- guards and sets


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def validated_left_join(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels")
    return guards.validated_join(docs, labels, ["doc_id"]).select("doc_id", "lang", "quality", "toxic")


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_missing(spark, d):
    return guards.missing_keys(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"])


@query(
    "WITH a AS (SELECT DISTINCT doc_id FROM documents), b AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) SELECT count(*) FILTER (b.doc_id IS NULL) AS only_left, count(*) FILTER (a.doc_id IS NULL) AS only_right, count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS in_both, "
    "count(*) FILTER (a.doc_id IS NULL OR b.doc_id IS NULL) = 0 AS equal FROM a FULL JOIN b ON a.doc_id = b.doc_id"
)
def set_overlap(spark, d):
    return guards.set_comparison(table(spark, d, "documents"), table(spark, d, "labels").where("quality = 1"), "doc_id")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return guards.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality")
def value_counts_null(spark, d):
    joined = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return summaries.value_counts(joined, "quality")


@query(
    "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.25), 6) AS p25, "
    "round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type"
)
def quantile_profile(spark, d):
    return rounded(summaries.quantile_profile(table(spark, d, "events"), ["event_type"], "value"))


@query(
    "WITH k AS (SELECT 'key_not_null' AS name, 'required' AS category, count(*) FILTER (NOT coalesce(o_orderkey IS NOT NULL, false)) AS n_failed FROM orders UNION ALL SELECT 'price_positive', 'required', count(*) FILTER (NOT coalesce(o_totalprice > 0, false)) FROM orders "
    "UNION ALL SELECT 'price_below_limit', 'future', count(*) FILTER (NOT coalesce(o_totalprice < 400000, false)) FROM orders) SELECT category, count(*) AS n_checks, count(*) FILTER (n_failed > 0) AS n_failed, CASE WHEN count(*) FILTER (n_failed > 0) = 0 THEN 'PASS' ELSE 'FAIL' END AS decision FROM k GROUP BY category"
)
def expectation_rollup(spark, d):
    checks = {
        "key_not_null": ("required", F.col("o_orderkey").isNotNull()),
        "price_positive": ("required", F.col("o_totalprice") > 0),
        "price_below_limit": ("future", F.col("o_totalprice") < 400_000),
    }
    return guards.decision(guards.expectations(table(spark, d, "orders"), checks))

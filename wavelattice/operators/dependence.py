"""Distances between all rows in tiles, distance correlation, permutations, and corrections for many tests."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_order
from ..sources.shared import Matrix, numbered, staged, write_matrix

#: Rows of a block; a tile holds the distances between two blocks.
BLOCK = 1024
#: Rows of a tile that stays in a core's cache, and of the spans that two of make a task.
TILE, SPAN = 256, 32768


def _tiles(df: DataFrame, keys: list[str], columns: list[str], fn: Callable, schema: str, block: int) -> DataFrame:
    """``fn(own, other, within)`` for every pair of blocks of the rows with equal ``keys``; ``own`` and ``other`` hold
    the columns as arrays (lists as matrices). Rows are dealt to blocks by hash and go to each tile of their block: the number of blocks
    times, and no pair of rows is ever a row."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_size")) if keys else df.agg(F.count("*").alias("_size"))
    parts = F.greatest(F.ceil(F.col("_size") / block), F.lit(1)).cast("int")
    sized = df.join(sizes, keys) if keys else df.crossJoin(F.broadcast(sizes))
    rows = sized.withColumn("_own", F.pmod(F.xxhash64(columns[0]), parts).cast("int")).withColumn("_with", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.withColumn("_i", F.least("_own", "_with")).withColumn("_j", F.greatest("_own", "_with"))
    tile = [*keys, "_i", "_j"]
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[pa.RecordBatch] = []

        def done():
            table = pa.Table.from_batches(held).combine_chunks()
            key = tuple(table.column(k)[0].as_py() for k in range(n + 2))
            i, j = key[n:]
            side = table.column(n + 2).to_numpy()
            arrays = [_array(table.column(k)) for k in range(n + 3, table.num_columns)]
            own = [a[side == i] for a in arrays]
            other = own if i == j else [a[side == j] for a in arrays]
            if len(own[0]) and len(other[0]):
                yield from fn(key[:n], own, other, i == j)

        for batch in batches:
            for start, stop in _tile_runs(batch, n + 2):
                part = batch.slice(start, stop - start)
                if held and any(part.column(k)[0] != held[0].column(k)[0] for k in range(n + 2)):
                    yield from done()
                    held = []
                held.append(part)
        if held:
            yield from done()

    dealt = rows.select(*tile, "_own", *columns).repartition(*tile).sortWithinPartitions(*tile, "_own", columns[0])
    return dealt.mapInArrow(run, schema)


def _array(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers as a vector, lists of equally many numbers as the rows of a matrix."""
    column = column.combine_chunks()
    if pa.types.is_list(column.type):
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
        return flat.reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


def _tile_runs(batch: pa.RecordBatch, columns: int) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of rows with equal values in the first columns."""
    if not batch.num_rows:
        return
    new = np.zeros(batch.num_rows - 1, bool)
    for k in range(columns):
        codes = batch.column(k).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new |= np.diff(codes) != 0
    bounds = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
    yield from zip(bounds, bounds[1:], strict=False)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between rows, equal ones at 0 exactly.

    Squares come from products about a common centre; those so small that rounding counts are worked out directly.
    """
    centre = a.mean(axis=0)
    a, b = a - centre, b - centre
    own, other = (a * a).sum(axis=1), (b * b).sum(axis=1)
    square = own[:, None] + other - 2 * a @ b.T
    x, y = np.nonzero(square <= 1e-9 * (own[:, None] + other))
    for at in range(0, x.size, 1 << 18):
        i, j = x[at : at + (1 << 18)], y[at : at + (1 << 18)]
        square[i, j] = ((a[i] - b[j]) ** 2).sum(axis=1)
    return np.sqrt(np.maximum(square, 0))


def nearest_neighbours(df: DataFrame, ident: str, vector: str, block: int = BLOCK) -> DataFrame:
    """``ident, neighbour, distance``: the nearest other row (of ties the least id); rows that are alone are left out."""

    def fn(_, own, other, within):
        ids, near = own[0], other[0]
        d = distances(own[1], other[1])
        if within:
            np.fill_diagonal(d, np.inf)
        sides = [(ids, near, d)] if within else [(ids, near, d), (near, ids, d.T)]
        for a, b, m in sides:
            order = np.argsort(b, kind="stable")
            at = order[m[:, order].argmin(axis=1)]
            best = m[np.arange(a.size), at]
            real = np.isfinite(best)
            yield pa.RecordBatch.from_arrays([pa.array(a[real], pa.int64()), pa.array(b[at][real], pa.int64()), pa.array(best[real])], names=[ident, "neighbour", "distance"])

    found = _tiles(df.select(ident, vector), [], [ident, vector], fn, f"`{ident}` long, neighbour long, distance double", block)
    best = found.groupBy(ident).agg(F.min(F.struct("distance", "neighbour")).alias("_b"))
    return best.select(ident, F.col("_b.neighbour").alias("neighbour"), F.col("_b.distance").alias("distance"))


def pairwise_rms(df: DataFrame, vector: str) -> DataFrame:
    """``n, radius_rms, pair_rms``: the root mean square of all pairs' distances from that of the distances to the mean.

    The mean squared distance of pairs is 2n / (n - 1) times the mean squared radius, so no pair is formed.
    """
    long = df.select(F.posexplode(vector).alias("pos", "x"))
    var = long.groupBy("pos").agg(F.var_pop("x").alias("v"), F.count("*").alias("n"))
    out = var.agg(F.max("n").alias("n"), F.sum("v").alias("r2"))
    return out.select("n", F.sqrt("r2").alias("radius_rms"), F.sqrt(F.lit(2.0) * F.col("n") / (F.col("n") - 1) * F.col("r2")).alias("pair_rms"))


def standardised(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """``df`` with array columns less their mean and by their population deviation, position by position, within ``keys``;
    a position whose deviation is at most 1e-12 is centred only."""
    keys = keys or []
    out = df
    for c in columns:
        cells = df.select(*keys, F.posexplode(c).alias("_pos", "_x")).groupBy(*keys, "_pos").agg(F.avg("_x").alias("_m"), F.stddev_pop("_x").alias("_s"))
        cell = F.struct("_pos", "_m", F.when(F.col("_s") <= 1e-12, 1.0).otherwise(F.col("_s")).alias("_s"))
        moments = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(cell)).alias("_moments"))
        z = F.zip_with(c, "_moments", lambda x, m: (x - m["_m"]) / m["_s"])
        out = (out.join(moments, keys) if keys else out.crossJoin(F.broadcast(moments))).withColumn(c, z).drop("_moments")
    return out


def sides(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows as two factors: one's product with the other's transpose holds the squared distances of all pairs."""
    square = (v * v).sum(axis=-1, keepdims=True)
    one = np.ones_like(square)
    return np.concatenate([-2 * v, square, one], axis=-1), np.concatenate([v, one, square], axis=-1)


def apart(own: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Distances between rows given as ``sides``, equal ones at 0 exactly; squares so small that rounding counts are
    worked out directly."""
    square = own[0] @ other[1].T
    least = 1e-9 * (own[1][:, -1].max() + other[1][:, -1].max())
    if square.min() <= least:
        i, j = np.nonzero(square <= least)
        square[i, j] = ((own[1][i, :-2] - other[1][j, :-2]) ** 2).sum(axis=1)
    return np.sqrt(square, out=square)


def row_sums(spark: SparkSession, data: Matrix, wide: int, block: int = TILE) -> DataFrame:
    """``row, sa, sb, ab, aa, bb``: each row's sums of its distances to all others, in the first ``wide`` columns and in the
    others; sums of products of distances stand in parts in some of the rows.

    A task compares two spans of rows, each pair of rows once, tile by tile, and returns a row for each row of its spans.
    """
    rows = data.rows
    span = -(-rows // max(16, -(-rows // SPAN)) // block) * block if rows else block
    first, second = np.triu_indices(-(-rows // span))

    def held(k: int):
        m = data.read(k * span, min((k + 1) * span, rows))
        return len(m), sides(m[:, :wide]), sides(m[:, wide:])

    def run(batches: Iterator[pa.RecordBatch]):
        for i, j in ((first[u], second[u]) for b in batches for u in b.column(0).to_pylist()):
            own = held(i)
            other = own if i == j else held(j)
            mine = np.zeros((2, own[0]))
            theirs = mine if i == j else np.zeros((2, other[0]))
            totals = np.zeros(3)
            for s in range(0, own[0], block):
                for t in range(s if i == j else 0, other[0], block):
                    a, b = (apart([f[s : s + block] for f in own[k]], [f[t : t + block] for f in other[k]]) for k in (1, 2))
                    within = i == j and s == t
                    totals += (1 if within else 2) * np.array([np.vdot(a, b), np.vdot(a, a), np.vdot(b, b)])
                    for k, m in enumerate((a, b)):
                        mine[k, s : s + block] += m.sum(axis=1)
                        if not within:
                            theirs[k, t : t + block] += m.sum(axis=0)
            for k, sums in ((i, mine),) if i == j else ((i, mine), (j, theirs)):
                parts = np.zeros((3, sums.shape[1]))
                if k == i and sums is mine:
                    parts[:, 0] = totals
                yield pa.RecordBatch.from_arrays([pa.array(k * span + np.arange(sums.shape[1])), *map(pa.array, sums), *map(pa.array, parts)], names=["row", "sa", "sb", "ab", "aa", "bb"])

    units = len(first)
    each = spark.range(0, units, 1, max(1, min(units, 4096))).mapInArrow(run, "row long, sa double, sb double, ab double, aa double, bb double")
    return each.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("sa", "sb", "ab", "aa", "bb")))


def distance_moments(sums: DataFrame) -> DataFrame:
    """``n, sa, cov, va, vb``: rows, the sum of the first distances, squared distance covariance and variances."""
    out = sums.agg(
        F.count("*").alias("n"),
        *(F.sum(c).alias(c) for c in ("sa", "sb", "ab", "aa", "bb")),
        F.sum(F.col("sa") * F.col("sb")).alias("rab"),
        F.sum(F.col("sa") * F.col("sa")).alias("raa"),
        F.sum(F.col("sb") * F.col("sb")).alias("rbb"),
    )
    n = F.col("n").cast("double")

    def squared(cross: str, rows_: str, u: str, v: str) -> Column:
        return F.greatest(F.col(cross) / (n * n) + F.col(u) * F.col(v) / (n * n * n * n) - 2 * F.col(rows_) / (n * n * n), F.lit(0.0))

    return out.select("n", "sa", squared("ab", "rab", "sa", "sb").alias("cov"), squared("aa", "raa", "sa", "sa").alias("va"), squared("bb", "rbb", "sb", "sb").alias("vb"))


def correlation(cov: Column, va: Column, vb: Column) -> Column:
    return F.when((va > 1e-15) & (vb > 1e-15), F.sqrt(cov / F.sqrt(va * vb))).otherwise(F.lit(0.0))


def distance_correlation(df: DataFrame, ident: str, x: str, y: str, block: int = TILE) -> DataFrame:
    """``n, dcor``: biased distance correlation of two standardised vector columns (0 where a distance variance is not
    positive). Rows are written once as a matrix, of which tasks read what they compare by number; none is sent to tiles."""
    rows = standardised(df.select(ident, x, y), [x, y])
    one = rows.select(F.size(x).alias("a")).first()
    data = write_matrix(rows, [ident], [x, y])
    found = distance_moments(row_sums(df.sparkSession, data, one.a if one else 0, block))
    return found.select("n", correlation(F.col("cov"), F.col("va"), F.col("vb")).alias("dcor"))


def hash_orders(df: DataFrame, ident: str, replicates: int, seed: int, within: str | None = None) -> Matrix:
    """Which row (by its number in the order of ``within`` and ``ident``) an order by hash puts in each place of every
    replicate from 1 on, one replicate behind the other; rows stay in their group."""
    group = [within] if within else []
    rows = numbered(df.select(*group, ident), [*group, ident], "_row").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    return write_matrix(staged(rows.withColumn("_hash", hash_order(F.col(ident), F.col("rep"), seed)), "hashes"), ["rep", *group, "_hash", ident], ["_row"])


def permutation_p(stats: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """``by, observed, n_reps, p``: of a table with ``rep``, where 0 is the observed one; counts those not below it."""
    by = by or []
    one = stats.where("rep = 0").select(*by, F.col(value).alias("observed"))
    drawn = stats.where("rep > 0")
    joined = drawn.join(one, by) if by else drawn.crossJoin(F.broadcast(one))
    out = joined.groupBy(*by, "observed").agg(F.count("*").alias("n_reps"), F.count_if(F.col(value) >= F.col("observed") - 1e-12).alias("_n"))
    return out.select(*by, "observed", "n_reps", ((F.col("_n") + 1) / (F.col("n_reps") + 1)).alias("p"))


def holm(df: DataFrame, p: str, out: str = "holm_p") -> DataFrame:
    """Step-down corrected p-values of a small table of tests."""
    k = df.withColumn("_m", F.count("*").over(Window.partitionBy())).withColumn("_r", F.row_number().over(Window.orderBy(p)))
    scaled = F.least(F.lit(1.0), (F.col("_m") - F.col("_r") + 1) * F.col(p))
    return k.withColumn(out, F.max(scaled).over(Window.orderBy("_r"))).drop("_m", "_r")


def benjamini_hochberg(df: DataFrame, p: str, out: str = "q") -> DataFrame:
    """False discovery rates of a small table of tests."""
    k = df.withColumn("_m", F.count("*").over(Window.partitionBy())).withColumn("_r", F.row_number().over(Window.orderBy(p)))
    scaled = F.least(F.lit(1.0), F.col("_m") * F.col(p) / F.col("_r"))
    back = Window.orderBy("_r").rowsBetween(0, Window.unboundedFollowing)
    return k.withColumn(out, F.min(scaled).over(back)).drop("_m", "_r")


# The distribution function of Poisson(1) for 0 to 7.
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]


def _poisson(ident: Column, replicate: Column, seed: int) -> Column:
    """A row's weight in a replicate. The digest's first twelve digits are the draw; digits compare like the numbers they write."""
    digest = hash_order(ident, replicate, seed)
    return sum(((digest >= f"{math.ceil(p * (1 << 48)):012x}").cast("long") for p in POISSON), F.lit(0))


def bootstrap_medians(df: DataFrame, ident: str, value: str, replicates: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """``by, rep, median``: medians of rows weighted by Poisson(1) draws from a hash, so that no sample is gathered.

    Rows are laid out once in the order of their values, in blocks. Every row is read once for each replicate, but only a
    block's weight by replicate is shuffled; a replicate's median is then looked for in the one or two blocks that hold it.
    """
    spark, by = df.sparkSession, by or []
    # As one struct, keys that are null or hold nulls are equal to themselves in joins.
    key = F.struct(*(F.col(b) for b in by), *([] if by else [F.lit(0).alias("all")])).alias("_g")
    rows = staged(df.select(key, F.col(ident).alias("_id"), F.col(value).cast("double").alias("_x")), "rows")
    count = rows.count()
    most = 16 * spark.sparkContext.defaultParallelism
    bits = max(6, (count // 4096).bit_length())
    tasks = max(1, min(most, count >> bits))
    at = F.shiftright(F.monotonically_increasing_id(), bits)
    laid = staged(rows.repartitionByRange(tasks, "_g", "_x").sortWithinPartitions("_g", "_x").withColumn("_block", at), "laid")
    dealt = laid.repartition(tasks, "_block")

    reps = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep")
    # No filter on the weight, which would work the digest out anew for each comparison.
    drawn = dealt.select("_g", "_block", "_x", "_id", reps).withColumn("_w", _poisson(F.col("_id"), F.col("rep"), seed))
    weights = staged(drawn.groupBy("_g", "rep", "_block").agg(F.sum("_w").alias("_any"), F.sum(F.when(F.col("_x").isNotNull(), F.col("_w"))).alias("_w")).where("_any > 0"), "weights")
    replicate = Window.partitionBy("_g", "rep")
    before = F.coalesce(F.sum("_w").over(replicate.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = weights.withColumns({"_before": before, "_all": F.sum("_w").over(replicate)})
    # Places of the middle, counted from 0 among the rows repeated by their weights.
    told = told.withColumns({"_lo": F.expr("(_all - 1) div 2"), "_hi": F.expr("_all div 2")})
    holds = lambda c: (F.col("_before") <= F.col(c)) & (F.col(c) < F.col("_before") + F.col("_w"))
    wanted = staged(told.where(holds("_lo") | holds("_hi")).select("_g", "_block", "rep", "_before", "_lo", "_hi"), "wanted")

    near = laid.where("_x is not null").join(wanted, ["_g", "_block"]).withColumn("_w", _poisson(F.col("_id"), F.col("rep"), seed))
    up_to = F.col("_before") + F.sum("_w").over(Window.partitionBy("_g", "rep", "_block").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    found = near.withColumn("_to", up_to).groupBy("_g", "rep").agg(*(F.min(F.when(F.col("_to") > F.col(c), F.col("_x"))).alias(c) for c in ("_lo", "_hi")))
    median = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(0.5 * F.col("_lo") + 0.5 * F.col("_hi")).alias("median")
    # A replicate whose drawn values are all null has a row as well.
    return weights.select("_g", "rep").distinct().join(found, ["_g", "rep"], "left").select(*(f"_g.{b}" for b in by), "rep", median)


def interval(df: DataFrame, value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(low), F.lit(0.5), F.lit(high)))
    return df.agg(F.count(value).alias("n"), q.alias("_q")).select("n", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("high"))


def null_summary(stats: DataFrame, value: str) -> DataFrame:
    """``observed, n_reps, p, null_median, null_q95, observed_minus_q95`` of a table with ``rep``, where 0 is observed."""
    p = permutation_p(stats, value)
    q = F.percentile(F.when(F.col("rep") > 0, F.col(value)), F.array(F.lit(0.5), F.lit(0.95)))
    both = p.crossJoin(F.broadcast(stats.agg(q.alias("_q"))))
    return both.select("observed", "n_reps", "p", F.col("_q")[0].alias("null_median"), F.col("_q")[1].alias("null_q95"), (F.col("observed") - F.col("_q")[1]).alias("observed_minus_q95"))

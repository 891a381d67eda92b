"""Running values over ordered rows, and interval joins made of them, without gathering a key.

Rows are dealt by ranges of (key, order), so that a key of any size is spread over many tasks. Each task's part of a key is
scanned on its own; what the parts before (or behind) it add up to comes from a table of a few rows a part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import staged

_MERGE = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least}
_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


@dataclass(frozen=True)
class Running:
    """A running ``kind`` ("sum", "max", "min") of a column, from the key's first row up to each (or from it to the last)."""

    kind: str
    value: Column
    backward: bool = False


def running(df: DataFrame, key: str, order: list[str], values: dict[str, Running]) -> DataFrame:
    """``df`` with the running values, within ``key`` in ``order`` (rows that tie in it stand in any order)."""
    named = {f"_v{i}": r.value for i, r in enumerate(values.values())}
    # Ranges are drawn from a sample, which would work the rows out twice; they are read back instead.
    laid = staged(df.withColumns(named), "rows").repartitionByRange(F.col(key), *(F.col(c) for c in order)).sortWithinPartitions(key, *order)
    laid = staged(laid.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "laid")

    sums = [_AGG[r.kind](f"_v{i}").alias(f"_t{i}") for i, r in enumerate(values.values())]
    parts = laid.groupBy(key, "_part").agg(*sums)
    # A key in more than one part is the first or the last of each of them: at most two rows a part, whatever the data.
    spread = parts.withColumn("_parts", F.count("*").over(Window.partitionBy(key))).where("_parts > 1")
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(key).orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    carried = [_AGG[r.kind](f"_t{i}").over(behind if r.backward else before).alias(f"_c{i}") for i, r in enumerate(values.values())]
    carry = staged(spread.select(F.col(key).alias("_key"), F.col("_part").alias("_its"), *carried), "carried")

    # Backward values run over the opposite order: a frame that ends behind the last row would be added up anew for each row.
    own = Window.partitionBy(key, "_part")
    up, down = (own.orderBy(at).rowsBetween(Window.unboundedPreceding, 0) for at in (F.asc("_at"), F.desc("_at")))
    local = laid.withColumns({f"_l{i}": _AGG[r.kind](f"_v{i}").over(down if r.backward else up) for i, r in enumerate(values.values())})
    met = local.join(F.broadcast(carry), (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_its")), "left")
    return met.select(*df.columns, *(_MERGE[r.kind](F.col(f"_c{i}"), F.col(f"_l{i}")).alias(name) for i, (name, r) in enumerate(values.items())))


#: At one moment, intervals that start come before probes, and those that stop behind them: both ends are closed.
#: Stops of intervals that hold no moment (no start, or a later one) count as history only.
STARTS, PROBES, STOPS, ENDED = 0, 1, 2, 3


def _events(probes: DataFrame, intervals: DataFrame, key: str, probe_id: str, t: str, start: str, stop: str, ident: str, flag: str | None = None) -> DataFrame:
    """Probes, starts and stops in one table: ``k, at, kind, probe, id, row``; for a flag also the stops of intervals that
    hold no moment, and each stop's ``flag``."""
    kind = lambda k: F.lit(k).alias("kind")
    stays = intervals.where(F.col(key).isNotNull() & (F.col(start) <= F.col(stop))).select(key, start, stop, F.col(ident).alias("id"), F.monotonically_increasing_id().alias("row"), *([F.col(flag).alias("flag")] if flag else []))
    ends = F.explode(F.array(F.struct(F.col(start).alias("at"), kind(STARTS)), F.struct(F.col(stop).alias("at"), kind(STOPS)))).alias("_e")
    none = lambda like, name: F.lit(None).cast(like).alias(name)
    flags = [F.when(F.col("_e.kind") == STOPS, F.col("flag")).alias("flag")] if flag else []
    ends = stays.select(F.col(key).alias("k"), "id", "row", ends, *(["flag"] if flag else [])).select("k", "_e.at", "_e.kind", none(probes.schema[probe_id].dataType, "probe"), "id", "row", *flags)
    asked = probes.where(F.col(key).isNotNull() & F.col(t).isNotNull()).select(F.col(key).alias("k"), F.col(t).alias("at"), kind(PROBES), F.col(probe_id).alias("probe"), F.lit(None).cast(intervals.schema[ident].dataType).alias("id"), F.lit(None).cast("long").alias("row"))
    if not flag:
        return ends.unionByName(asked)
    past = intervals.where(F.col(key).isNotNull() & F.col(stop).isNotNull() & ~F.coalesce(F.col(start) <= F.col(stop), F.lit(False)))
    past = past.select(F.col(key).alias("k"), F.col(stop).alias("at"), kind(ENDED), none(probes.schema[probe_id].dataType, "probe"), none(intervals.schema[ident].dataType, "id"), none("long", "row"), F.col(flag).alias("flag"))
    return ends.unionByName(asked.withColumn("flag", F.lit(None).cast(intervals.schema[flag].dataType))).unionByName(past)


def _levels(swept: DataFrame) -> int:
    most = swept.where(F.col("kind") == PROBES).agg(F.max("rank")).first()[0]
    return max(int(most or 1) - 1, 0).bit_length()


def _holding(swept: DataFrame) -> DataFrame:
    """``probe, n, id``: how many intervals hold each probe, and the least id; probes that none holds are left out.

    An interval holds consecutive probes of its key. Their numbers are cut into aligned runs of powers of two, at most two
    of each size; runs with a count and a least id meet each probe by equality, once a size.
    """
    levels = _levels(swept)
    # ``rank`` counts probes up to a row: below a start are the probes before it, below a stop those it holds and before.
    spans = swept.where(F.col("kind").isin(STARTS, STOPS)).groupBy("k", "row").agg(F.first("id").alias("id"), F.min("rank").alias("lo"), F.max("rank").alias("hi")).where("lo < hi")
    runs = []
    for level in range(levels + 1):
        lo, hi = F.shiftright(F.col("lo") + ((1 << level) - 1), level), F.shiftright(F.col("hi"), level)
        for end, node in ((lo, lo), (hi, hi - 1)):
            runs.append(F.when((lo < hi) & (end % 2 == 1), F.struct(F.lit(level).alias("level"), node.alias("node"))))
    pieces = spans.select("k", "id", F.explode(F.array_compact(F.array(*runs))).alias("_n")).groupBy("k", "_n.level", "_n.node").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    asked = swept.where(F.col("kind") == PROBES).select("k", "probe", F.explode(F.array(*(F.struct(F.lit(level).alias("level"), F.shiftright(F.col("rank") - 1, level).alias("node")) for level in range(levels + 1)))).alias("_n"))
    met = asked.select("k", "probe", "_n.level", "_n.node").join(pieces, ["k", "level", "node"])
    return met.groupBy("probe").agg(F.sum("n").alias("n"), F.min("id").alias("id"))


def _ranked(events: DataFrame, more: dict[str, Running] | None = None) -> DataFrame:
    rank = Running("sum", (F.col("kind") == PROBES).cast("long"))
    return staged(running(events, "k", ["at", "kind", "probe", "row"], {"rank": rank, **(more or {})}), "swept")


def containment(probes: DataFrame, intervals: DataFrame, key: str, *, probe_id: str, t: str = "t", start: str = "start", stop: str = "stop", ident: str = "interval_id") -> DataFrame:
    """``probe_id, n_exact, exact_id``: intervals of the key that hold the moment (both ends closed); the id if just one.

    ``probe_id`` tells probes apart; a probe without a key or moment is held by none.
    """
    probes = staged(probes.select(probe_id, *{key, t} - {probe_id}), "probes")
    held = _holding(_ranked(_events(probes, intervals, key, probe_id, t, start, stop, ident)))
    out = probes.select(probe_id).join(held.withColumnRenamed("probe", probe_id), probe_id, "left")
    return out.select(probe_id, F.coalesce("n", F.lit(0)).alias("n_exact"), F.when(F.col("n") == 1, F.col("id")).alias("exact_id"))


def nearest(probes: DataFrame, intervals: DataFrame, key: str, *, probe_id: str, t: str = "t", start: str = "start", stop: str = "stop", ident: str = "interval_id") -> DataFrame:
    """``probe_id, gap_h, direction, ties, nearest_id``: the nearest interval (0 hours inside; of ties the least id)."""
    probes = staged(probes.select(probe_id, *{key, t} - {probe_id}), "probes")
    swept = _ranked(_events(probes, intervals, key, probe_id, t, start, stop, ident), _edges())
    return _nearest(probes, swept, _holding(swept), probe_id)


def _edges() -> dict[str, Running]:
    """The latest end before a row, and the earliest start behind it."""
    return {"ended": Running("max", F.when(F.col("kind") == STOPS, F.col("at"))), "coming": Running("min", F.when(F.col("kind") == STARTS, F.col("at")), backward=True)}


def links(probes: DataFrame, intervals: DataFrame, key: str, *, probe_id: str, flag: str, t: str = "t", start: str = "start", stop: str = "stop", ident: str = "interval_id") -> DataFrame:
    """What ``containment``, ``prior_history`` and ``nearest`` find, from one sweep: ``probe_id, n_exact, exact_id, n_prior,
    prior_flag, gap_h, direction, ties, nearest_id``. What each step finds is written, so that no plan holds two of them."""
    probes = staged(probes.select(probe_id, *{key, t} - {probe_id}), "probes")
    past = {"n_prior": Running("sum", (F.col("kind") >= STOPS).cast("long")), "prior_flag": Running("max", F.col("flag"))}
    swept = _ranked(_events(probes, intervals, key, probe_id, t, start, stop, ident, flag), _edges() | past)
    held = staged(_holding(swept), "held")
    near = staged(_nearest(probes, swept, held, probe_id), "near")
    own = swept.where(F.col("kind") == PROBES).select(F.col("probe").alias(probe_id), *past)
    out = near.join(own, probe_id, "left").join(held.withColumnRenamed("probe", probe_id), probe_id, "left")
    exact = [F.coalesce("n", F.lit(0)).alias("n_exact"), F.when(F.col("n") == 1, F.col("id")).alias("exact_id")]
    return out.select(probe_id, *exact, F.coalesce("n_prior", F.lit(0)).alias("n_prior"), "prior_flag", "gap_h", "direction", "ties", "nearest_id")


def _nearest(probes: DataFrame, swept: DataFrame, held: DataFrame, probe_id: str) -> DataFrame:
    from ..functions.scalars import seconds_between

    ends = swept.where(F.col("kind") != PROBES).groupBy("k", "kind", "at").agg(F.count("*").alias("n"), F.min("id").alias("id"))

    asked = swept.where(F.col("kind") == PROBES).select("k", "probe", "at", "ended", "coming")
    found = asked.join(held.select("probe", F.col("n").alias("n_in"), F.col("id").alias("id_in")), "probe", "left")
    for kind, moment, name in ((STOPS, "ended", "a"), (STARTS, "coming", "b")):
        own = ends.where(F.col("kind") == kind).select("k", F.col("at").alias(moment), F.col("n").alias(f"n_{name}"), F.col("id").alias(f"id_{name}"))
        found = found.join(own, ["k", moment], "left")
    after = F.when(F.col("n_in").isNull(), seconds_between(F.col("ended"), F.col("at")) / 3600)
    before = F.when(F.col("n_in").isNull(), seconds_between(F.col("at"), F.col("coming")) / 3600)
    cases = F.array_compact(
        F.array(
            F.when(F.col("n_in").isNotNull(), F.struct(F.lit(0.0).alias("gap"), F.col("id_in").alias("id"), F.lit("inside").alias("direction"), F.col("n_in").alias("n"))),
            F.when(after.isNotNull(), F.struct(after.alias("gap"), F.col("id_a").alias("id"), F.lit("after_end").alias("direction"), F.col("n_a").alias("n"))),
            F.when(before.isNotNull(), F.struct(before.alias("gap"), F.col("id_b").alias("id"), F.lit("before_start").alias("direction"), F.col("n_b").alias("n"))),
        )
    )
    best = found.select("probe", cases.alias("_cases"), F.array_min(cases).alias("_best"))
    ties = F.aggregate("_cases", F.lit(0).cast("long"), lambda total, c: total + F.when(F.round(c["gap"], 12) == F.round(F.col("_best.gap"), 12), c["n"]).otherwise(F.lit(0).cast("long")))
    best = best.select(F.col("probe").alias(probe_id), "_best", ties.alias("_ties"))
    out = probes.select(probe_id).join(best, probe_id, "left")
    return out.select(probe_id, F.col("_best.gap").alias("gap_h"), F.coalesce("_best.direction", F.lit("missing")).alias("direction"), F.coalesce("_ties", F.lit(0)).alias("ties"), F.col("_best.id").alias("nearest_id"))


def prior_history(probes: DataFrame, intervals: DataFrame, key: str, *, probe_id: str, t: str = "t", stop: str = "stop", flag: str | None = None) -> DataFrame:
    """``probe_id, n_prior`` (intervals that ended strictly before) and, for a flag, whether any of them has it."""
    probes = staged(probes.select(probe_id, *{key, t} - {probe_id}), "probes")
    marks = intervals.where(F.col(key).isNotNull() & F.col(stop).isNotNull())
    kind = intervals.schema[flag].dataType if flag else "int"
    ends = marks.select(F.col(key).alias("k"), F.col(stop).alias("at"), F.lit(STOPS).alias("kind"), F.lit(None).cast(probes.schema[probe_id].dataType).alias("probe"), (F.col(flag) if flag else F.lit(None).cast("int")).alias("flag"), F.monotonically_increasing_id().alias("row"))
    asked = probes.where(F.col(key).isNotNull() & F.col(t).isNotNull()).select(F.col(key).alias("k"), F.col(t).alias("at"), F.lit(PROBES).alias("kind"), F.col(probe_id).alias("probe"), F.lit(None).cast(kind).alias("flag"), F.lit(None).cast("long").alias("row"))
    values = {"n_prior": Running("sum", (F.col("kind") == STOPS).cast("long"))} | ({"prior_flag": Running("max", F.col("flag"))} if flag else {})
    swept = running(ends.unionByName(asked), "k", ["at", "kind", "probe", "row"], values).where(F.col("kind") == PROBES)
    out = probes.select(probe_id).join(swept.select(F.col("probe").alias(probe_id), *values), probe_id, "left")
    return out.select(probe_id, F.coalesce("n_prior", F.lit(0)).alias("n_prior"), *(["prior_flag"] if flag else []))

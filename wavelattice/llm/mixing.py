"""Mixing sources to target weights: repetition rates by source, copies by floor and one seeded Bernoulli draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import lookup, staged, text_or_empty, whole

#: A source is repeated at most so often.
MOST = 3
WORD = r"[^\x20\x09-\x0D]+"


def source_key(source: str) -> Column:
    """A key that is never null: the source behind a letter, or another letter for null (which sorts last)."""
    return F.when(F.col(source).isNull(), F.lit("~n")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))


def draw(ident: Column, ordinal: Column, seed: int) -> Column:
    """A number in [0, 1) from a hash of the seed and the document: the same in every run and every order."""
    digest = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), ident, ordinal.cast("string"))), 1, 12)
    return F.conv(digest, 16, 10).cast("double") / F.lit(float(1 << 48))


def numbered(df: DataFrame, by: str) -> DataFrame:
    """``df`` with ``_ordinal``, which of the rows of its ``by`` a row is, from 0.

    Rows that are alone stay where they are. Of the others, those of one group are counted within the partitions they
    come from, and the partitions' counts are summed up: no group meets in one task.
    """
    groups = staged(df.groupBy(by).agg(F.count("*").alias("_n")).where("_n > 1"), "repeated")
    if groups.isEmpty():
        return df.withColumn("_ordinal", F.lit(0).cast("long"))
    marked = lookup(df, groups, by, "_n")
    alone = marked.where("_n is null").drop("_n").withColumn("_ordinal", F.lit(0).cast("long"))
    again = staged(marked.where("_n is not null").drop("_n").withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()), "again")
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = again.groupBy(by, "_part").agg(F.count("*").alias("_c"))
    bases = counts.select(by, "_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy(by, "_part").orderBy("_row"))
    ordinal = (F.col("_base") + F.col("_own") - 1).alias("_ordinal")
    placed = again.withColumn("_own", own).join(bases.hint("shuffle_hash"), [by, "_part"])
    return alone.unionByName(placed.select(*df.columns, ordinal))


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` (unique in ``key``) with ``rank``, counted from 0 in the order of keys.

    Keys are dealt by ranges; a partition's own rows are counted in it and only the partitions' sizes are summed up.
    """
    dealt = staged(sources.repartitionByRange(F.col("key")).sortWithinPartitions("key").withColumn("_row", F.monotonically_increasing_id()), "sources")
    part = F.shiftright(F.col("_row"), 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    rank = (F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")).alias("rank")
    return dealt.withColumn("_part", part).join(sizes, "_part").select(*sources.columns, rank)


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """``sources`` (``key``, ``words``) with ``weight`` and ``target``.

    All words are shared by weight; a target stops at ``most`` times its source's words, and the excess is shared
    again by weight among the others until none is above. Each round is one sum over the sources; the driver sees
    three numbers of it. Sources that have no words get none.
    """
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    out = staged(ranked(sources).withColumn("weight", weight.cast("long")), "weights")
    total = out.agg(F.sum("words")).first()[0] or 0
    shared = None
    cap = F.col("words") * most
    while True:
        # A source stays capped once it is: the share of a weight only grows.
        capped = F.lit(False) if shared is None else cap * F.lit(shared[1]) < F.col("weight") * F.lit(shared[0])
        row = out.agg(F.sum(F.when(capped, cap).otherwise(0)), F.sum(F.when(capped, 0).otherwise(F.col("weight")))).first()
        now = (total - (row[0] or 0), row[1] or 0)
        if now == shared or not now[1]:
            break
        shared = now
    left, weighed = shared or (0, 1)
    share = F.col("weight") * F.lit(float(left)) / F.lit(float(max(1, weighed)))
    return out.withColumn("target", F.least(share, cap.cast("double")))


def mix(df: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 8, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """``df`` with ``size``, ``source_size``, ``target``, ``rate`` and ``copies`` (how often the mix holds the document).

    ``size`` counts runs of characters other than white space (null: 0). A document is taken floor(rate) times, and
    once more with a probability of the rate's fraction, drawn from a hash of the seed, ``key``, the text's MD5 and,
    among rows that have all of these and the source in common, the row's number: null and repeated keys draw apart.
    No row is dropped; columns of the outputs' names are replaced. Null is a source of its own, the last. Sizes are
    summed by source before any shuffle; the rates come back by a join in which a hot source's rows never meet in one
    task.
    """
    made = ("size", "source_size", "target", "rate", "copies")
    kept = [c for c in df.columns if c not in made]
    ident = F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(text_or_empty(text)))
    base = df.select(whole(kept), F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long").alias("size"), source_key(source).alias("_key"), ident.alias("_ident"))
    sums = staged(base.groupBy("_key").agg(F.sum("size").alias("words"), F.count("*").alias("rows")).withColumnRenamed("_key", "key"), "sums")
    rates = staged(targets(sums, weights, most).select(F.col("key").alias("_key"), F.col("words").alias("source_size"), "target", "rows"), "rates")
    base = numbered(base.withColumn("_same", F.concat_ws(":", "_ident", "_key")), "_same")
    joined = lookup(base, rates, "_key", "rows")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    times = F.floor("rate")
    extra = (draw(F.col("_ident"), F.col("_ordinal"), seed) < F.col("rate") - times).cast("long")
    return joined.withColumn("rate", rate).select("_doc.*", "size", "source_size", "target", "rate", (times + extra).alias("copies"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: every document as often as its ``copies`` say."""
    return mixed.select(whole(mixed.columns), F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("_doc.*")

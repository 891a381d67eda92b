"""Bottom-k sketches of shingle hashes with built-in functions only: mergeable, for resemblance, containment and size."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import shuffle_width, text_or_empty

K, WORDS = 128, 5
#: Documents that one window bucket holds on average, the most buckets, and the exactness of their bounds.
BUCKET_ROWS, MOST_BUCKETS, ACCURACY = 500, 16_384, 100_000


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Distinct 64-bit hashes of the runs of ``words`` words (one of all words, where there are fewer), sorted.

    Words are what white space parts. No word, no shingle.
    """
    hashed = F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(h) - words, F.lit(0)))
        found = F.transform(starts, lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(words))))
        return F.when(F.size(h) > 0, F.array_distinct(found)).otherwise(F.expr("cast(array() as array<bigint>)"))

    # The array of hashes is bound to a variable, so that it is computed once and not for every shingle.
    return F.get(F.transform(F.array(hashed), runs), F.lit(0))


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """The ``k`` least hashes of a text's shingles, sorted; all of them where there are fewer."""
    return F.slice(F.sort_array(shingle_hashes(text, words)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the shared part of both sets' union (1 for two empty sets)."""
    both = F.get(F.transform(F.array(merged(a, b, k)), lambda u: F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u)), F.lit(0))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both)


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimate of a set's size: exact below ``k``, else from the largest hash kept."""
    reach = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / reach)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the part of ``a`` that lies in ``b`` (1 for an empty ``a``)."""
    together = distinct_count(merged(a, b, k), k) * resemblance(a, b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), together / distinct_count(a, k)))


def printed(a: Column) -> Column:
    """A sketch as text: 16 hex digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def merge_groups(df: DataFrame, by: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """The sketch of every group of rows. Hashes are made distinct before a window keeps the least ``k`` of each group,
    of which each task passes on ``k`` at most; no group is gathered whole."""
    hashes = df.select(*by, F.explode(column).alias("_h")).distinct()
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("_h"))
    least = hashes.withColumn("_rank", rank).where(F.col("_rank") <= k)
    return least.groupBy(*by).agg(F.sort_array(F.collect_list("_h")).alias(column))


def _long(value: int) -> str:
    return f"{value}L" if value > -(2**63) else "-9223372036854775807L - 1L"


class Buckets:
    """Buckets of neighbouring keys, in order, each with sub-buckets for a hot key's rows and one for the rest.

    The bounds are quantiles of all keys, as exact as ``ACCURACY`` allows, from one pass over the keys alone. A key that
    is several bounds at once is hot; its rows, and those of null keys, which come first, are dealt to so many
    sub-buckets by ranges of their texts' hashes.
    """

    def __init__(self, df: DataFrame, key: str):
        rows, n, least = df.agg(F.count("*"), F.count(key), F.min(key)).first()
        size = max(BUCKET_ROWS, -(-rows // MOST_BUCKETS))
        parts = max(1, n // size)
        inner = [i / parts for i in range(1, parts)]
        row = df.agg(F.percentile_approx(key, inner, ACCURACY)).first()[0] if inner else []
        seen = Counter([*(row or []), *([least] if n else [])])
        self.key = key
        self.nulls = -(-(rows - n) // size)
        self.bounds = sorted(seen)
        self.hot = {b: times for b, times in seen.items() if times > 1}
        parts_of = [self.nulls, *(self.hot.get(b, 0) for b in self.bounds)]  # for hot rows
        self.parts = parts_of
        self.first = list(accumulate((p + 1 for p in parts_of), initial=0))

    @property
    def uneven(self) -> bool:
        return bool(self.nulls or self.hot)

    def is_hot(self) -> Column:
        return F.col(self.key).isNull() | (F.col(self.key).isin(list(self.hot)) if self.hot else F.lit(False))

    def number(self, hash_: str, hot: str) -> Column:
        """The sub-bucket of a row; the bucket is found through a list of lists, by two short scans."""
        bounds = self.bounds or [0]
        width = max(1, round(len(bounds) ** 0.5))
        table = F.expr("array(" + ", ".join(_array(map(_long, bounds[i : i + width])) for i in range(0, len(bounds), width)) + ")")
        outer = F.greatest(F.size(F.filter(table, lambda r: F.get(r, F.lit(0)) <= F.col(self.key))) - 1, F.lit(0))
        inside = F.greatest(F.size(F.filter(F.get(table, outer), lambda b: b <= F.col(self.key))) - 1, F.lit(0))
        bucket = F.when(F.col(self.key).isNull(), F.lit(0)).otherwise(outer * width + inside + 1).cast("int")
        if not self.uneven:
            return bucket
        parts, first = (F.get(F.expr(_array(map(str, x))), bucket) for x in (self.parts, self.first))
        share = (F.col(hash_).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
        return (first + F.when(F.col(hot), F.least(F.floor(share * parts), parts - 1)).otherwise(parts)).cast("int")


def _long(value: int) -> str:
    return f"{value}L" if value > -(2**63) else "-9223372036854775807L - 1L"


def _array(items: Iterable[str]) -> str:
    return "array(" + ", ".join(items) + ")"


def with_next(df: DataFrame, key: str, column: str, made: dict[str, Column] | None = None, prefix: str = "next_") -> DataFrame:
    """``key``, ``column`` (a string), the columns ``made`` of it, and all but the key of the next row.

    The next row is that in ascending order of ``key`` (null first; rows of one key by hash and text); the last row's
    is the first. Other columns are not kept. Rows are dealt by buckets of neighbouring keys; a bucket's first rows go
    to the bucket before as well, so that a window within a bucket sees every neighbour. Equal rows of a hot key are
    one row with their number until the end, and the rows of a hot key go to several buckets: none is large, whatever
    repeats. ``made`` is worked out behind the shuffle.
    """
    found = Buckets(df, key)
    rows = df.select(key, column, F.xxhash64(column).alias("_hash"), F.lit(1).cast("long").alias("_times"), found.is_hot().alias("_hot"))
    if found.uneven:
        counted = rows.where("_hot").groupBy(key, column, "_hash", "_hot").agg(F.sum("_times").alias("_times"))
        rows = rows.where("not _hot").unionByName(counted.select(*rows.columns))
    rows = rows.withColumn("_bucket", found.number("_hash", "_hot"))
    if found.uneven:
        # Which buckets have rows, and their first ones: one row a bucket.
        heads = {r["_bucket"]: r["_head"] for r in rows.groupBy("_bucket").agg(F.min(F.struct(F.col(key).alias("k"), F.col("_hash").alias("h"))).alias("_head")).collect()}
        order = sorted(heads)
        before_ = {b: order[i - 1] for i, b in enumerate(order)}
        every = range(order[-1] + 1 if order else 1)
        at = lambda values, kind: F.get(F.expr(f"cast({_array(values)} as array<{kind}>)"), F.col("_bucket"))
        head_key = at(("null" if b not in heads or heads[b]["k"] is None else _long(heads[b]["k"]) for b in every), "bigint")
        head_hash = at(("null" if b not in heads else _long(heads[b]["h"]) for b in every), "bigint")
        before = at((str(before_.get(b, 0)) for b in every), "int")
        opens = F.col(key).eqNullSafe(head_key) & (F.col("_hash") == head_hash)
    else:
        # Every bound is a key that occurs, and bucket 0 (null keys) is empty.
        opens = F.col(key) == F.get(F.expr(_array(["null", *map(_long, found.bounds)])), F.col("_bucket"))
        before = F.when(F.col("_bucket") == 1, F.lit(len(found.bounds))).otherwise(F.col("_bucket") - 1)
    here = F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("extra"))
    there = F.struct(before.cast("int").alias("b"), F.lit(1).alias("extra"))
    placed = rows.withColumn("_at", F.explode(F.when(opens, F.array(here, there)).otherwise(F.array(here))))
    placed = placed.select(key, column, "_hash", "_times", F.col("_at.b").alias("_bucket"), F.col("_at.extra").alias("_extra"))
    dealt = placed.repartition(shuffle_width(df.sparkSession), "_bucket")
    made = made or {}
    for name, value in made.items():
        dealt = dealt.withColumn(name, value)
    names = [column, *made]
    window = Window.partitionBy("_bucket").orderBy("_extra", F.col(key).asc_nulls_first(), "_hash", column)
    out = dealt.withColumn("_next", F.lead(F.struct(*names)).over(window)).where("_extra = 0")
    nexts = [F.col(f"_next.{c}").alias(prefix + c) for c in names]
    if not found.uneven:
        return out.select(key, *names, *nexts)
    alone = out.where("_times = 1").select(key, *names, *nexts)
    # All but the last of equal rows are followed by their like; very many are told out in several tasks.
    blocks = out.where("_times > 1").withColumn("_block", F.explode(F.sequence(F.lit(0), F.expr("cast((_times - 1) div 65536 as int)"))))
    told = blocks.repartition(shuffle_width(df.sparkSession), "_hash", "_block").withColumn("_k", F.explode(F.sequence(F.lit(1), F.least(F.lit(65536), F.col("_times") - F.col("_block") * 65536).cast("int"))))
    final = (F.col("_block") == 0) & (F.col("_k") == 1)
    return alone.unionByName(told.select(key, *names, *(F.when(final, F.col(f"_next.{c}")).otherwise(F.col(c)).alias(prefix + c) for c in names)))


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last quarter of code points replaced by the first as many (or all) of ``following``."""
    n = F.char_length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - quarter), F.substr(following, F.lit(1), quarter))


def fingerprints(df: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = K, words: int = WORDS) -> DataFrame:
    """``key`` and sketches of every text (null: empty), of its edited form, and of the next document.

    Other columns are not kept. Rows that repeat a key follow each other in the order of their texts' hashes, then texts. Equal texts have
    equal sketches; texts without words have empty ones, which resemble each other fully and any other not at all.
    """
    base = df.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    linked = with_next(base, "doc_id", "text", {"sketch": sketch(F.col("text"), k, words)})
    linked = linked.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    return linked.withColumn("edited_sketch", sketch(F.col("edited"), k, words))

"""A training-data pipeline over ``documents``: quality, near duplicates, secrets, source mix, token ids.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's ``docs``.
All but the last return the columns that they were given. Joins back to the documents go by the key and a digest of the
text, null-safe, so that rows that repeat a key with another text are told apart; rows that share both, however many,
never meet in one task.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelattice.llm import bpe, jaccard, kneser, mixing, novelty
from wavelattice.llm.shared import fresh, light_batches, lookup, scratch, staged, text_or_empty, whole


def ident(*parts: Column) -> Column:
    """One string for a row's values, nulls told apart from all others."""
    return F.concat_ws("|", *(F.coalesce(F.concat(F.lit("v"), p.cast("string")), F.lit("n")) for p in parts))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps; empty ones go. A row's decision follows its key, text and language."""
    light_batches(spark)
    found = kneser.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    gone = found.where(~F.col("keep")).groupBy(ident(F.col("doc_id"), F.col("text_hash"), F.col("lang")).alias("_ident")).agg(F.count("*").alias("_n"))
    own = ident(F.col("doc_id").cast("long"), kneser.text_hash(), F.col("lang"))
    return lookup(docs.select(whole(docs.columns), own.alias("_ident")), staged(gone, "rejected"), "_ident", "_n").where("_n is null").select("_doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, the one of the least key (null keys last); of repeated rows one."""
    light_batches(spark)
    found = jaccard.join(docs).withColumn("_ident", ident(F.col("doc_id"), F.col("ck")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("ck").alias("ck"))
    rows = staged(found.groupBy("_ident").agg(F.first("class_key").alias("class_key"), F.first(order).alias("order"), F.count("*").alias("_n")), "rows")
    first = rows.groupBy("class_key").agg(F.min(F.struct("order", "_ident")).alias("first"))
    chosen = staged(first.select(F.col("first._ident").alias("_ident"), F.lit(True).alias("_chosen")), "chosen")
    other = staged(rows.join(chosen, "_ident", "left").where("_chosen is null or _n > 1").select("_ident", "_n", "_chosen"), "others")
    own = ident(F.col("doc_id").cast("long"), F.md5(text_or_empty("text")))
    marked = lookup(docs.select(whole(docs.columns), own.alias("_ident")), other, "_ident", "_n")
    single = marked.where("_n is null").select("_doc.*")
    if other.where("_chosen").isEmpty():
        return single
    again = marked.where("_chosen").dropDuplicates(["_ident"])
    return single.unionByName(again.select("_doc.*"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with ``[SECRET]`` in place of each span that the scan reports, and its length counted anew."""
    light_batches(spark)
    digest = F.md5(text_or_empty("text"))
    found = novelty.scan(docs.select(digest.alias("_ck"), "text"), spans="_spans").where(F.size("_spans") > 0)
    hits = staged(found.groupBy("_ck").agg(F.first("_spans").alias("_spans"), F.count("*").alias("_n")), "hits")
    marked = lookup(docs.select(whole(docs.columns), digest.alias("_ck")), hits, "_ck", "_n")
    clean = marked.where("_n is null").select("_doc.*")
    spans = fresh(docs.columns, "_spans")
    hidden = novelty.redact(marked.where("_n is not null").select("_doc.*", F.col("_spans").alias(spans)), spans=spans)
    if "n_chars" in docs.columns:
        hidden = hidden.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean.unionByName(hidden.select(*docs.columns))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.repeated(mixing.mix(docs)).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether the ids that are handed on decode to it exactly."""
    light_batches(spark)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = docs.select("doc_id", "lang", "source", "text", F.md5(text_or_empty("text")).alias("_ck"))
    # The ids are written before they are decoded, so that a task runs one Python worker and decodes what it reads.
    stored = staged(bpe.encode(own, ranks).drop("text"), "ids")
    exact = F.md5("decoded") == F.col("_ck")
    return bpe.decode(stored, ranks).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", exact.alias("exact"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scan", secrets),
    ("source mix", source_mix),
    ("byte-level BPE", token_ids),
]

#: The Kneser-Ney model and the byte-level merges are not expressible in SQL; tests compare the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Quality classifier: interpolated modified Kneser-Ney model of n-grams of UTF-8 bytes, fitted on trusted text.

Documents lie in chunks, bounded runs of rows. The n-grams of each chunk are counted in the tasks that read it; their
counts are summed by n-gram, and the probabilities worked out order by order by joins of count tables, sharded by key.
A last join gives every chunk the probabilities of its own n-grams, from which its documents add up their logarithms. A
document is kept while its perplexity is at most a quantile of its language's trusted documents that the fit did not
see.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .files import open_fs, pack, unpack, write_whole
from .shared import located, lookup, scratch, shuffle_width, sized_broadcast, staged, text_batches, text_or_empty

#: Bytes of an n-gram; a symbol is a byte plus 1, or 0 before the start of a text, so that a key fits a long.
ORDER = 5
SYMBOL_BITS = 9
#: One trusted document in so many is held out of the fit, for the thresholds.
HELD_OUT = 5
QUANTILE = 0.985
BATCH_CHARS = 500_000
#: Rows of a file that make a chunk, and n-grams of a chunk that a worker reads at a time.
CHUNK_ROWS, PIECE_ROWS = 8_192, 1_000_000


def ngram_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte, as one integer, and the texts' lengths in bytes."""
    encoded = [t.encode("utf-8", "replace") for t in texts]
    lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
    pad = b"\0" * (ORDER - 1)
    points = np.frombuffer(b"".join(pad + e for e in encoded), np.uint8).astype(np.int64) + 1
    real = np.ones(points.size, bool)
    starts = np.cumsum(lengths + ORDER - 1) - (lengths + ORDER - 1)
    real[(starts[:, None] + np.arange(ORDER - 1)).ravel()] = False
    points[~real] = 0
    keys = np.zeros(points.size, np.int64)
    for back in range(ORDER):
        keys[back:] |= points[: points.size - back] << (SYMBOL_BITS * back)
    return keys[real], lengths


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_chunk``, a number of the file and the run of rows that each row was read from."""
    chunk = F.xxhash64("_file", F.floor(F.col("_line") / CHUNK_ROWS))
    return located(docs).withColumn("_chunk", chunk).drop("_file", "_line")


def _runs(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[int, pa.RecordBatch, list[str]]]:
    """Batches of texts of one chunk each (the first column), of bounded length."""
    for batch, texts in text_batches(batches, text, BATCH_CHARS):
        chunks = batch.column(0).to_numpy()
        bounds = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(texts)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield int(chunks[a]), batch.slice(a, b - a), texts[a:b]


def count_ngrams(df: DataFrame, text: str, trained: str) -> DataFrame:
    """``chunk, key, c`` for the n-grams of each chunk; ``c`` counts them in rows where ``trained`` holds (else 0).

    A chunk that several tasks read has several rows an n-gram, and so has one of very many n-grams.
    """

    def merge(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(inverse, np.concatenate([c for _, c in held]), keys.size).astype(np.int64)

    def emit(chunk: int, held) -> Iterator[pa.RecordBatch]:
        keys, counts = merge(held)
        for at in range(0, keys.size, 500_000):
            part = keys[at : at + 500_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(part.size, chunk)), pa.array(part), pa.array(counts[at : at + 500_000])], names=["chunk", "key", "c"])

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        current, fresh = None, 0
        for chunk, batch, texts in _runs(batches, text):
            if held and (chunk != current or fresh > PIECE_ROWS):
                if chunk == current:
                    held = [merge(held)]
                    fresh = 0
                if chunk != current or held[0][0].size > PIECE_ROWS:
                    yield from emit(current, held)
                    held, fresh = [], 0
            current = chunk
            keys, lengths = ngram_keys(texts)
            if keys.size:
                weight = np.repeat(batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64), lengths)
                found, inverse = np.unique(keys, return_inverse=True)
                held.append((found, np.bincount(inverse, weight, found.size).astype(np.int64)))
                fresh += found.size
        if held:
            yield from emit(current, held)

    return df.select("_chunk", text, F.col(trained).cast("boolean").alias("_trained")).mapInArrow(run, "chunk long, key long, c long")


def discounts(ones: int, twos: int, threes: int, fours: int) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from the counts of counts; a half where there are too few."""
    if not (ones and twos and threes):
        return 0.5, 0.5, 0.5
    y = ones / (ones + 2 * twos)
    return tuple(min(max(d, 0.0), float(k)) for k, d in enumerate((1 - 2 * y * twos / ones, 2 - 3 * y * threes / twos, 3 - 4 * y * fours / threes), 1))


def probabilities(counts: DataFrame) -> DataFrame:
    """``key`` and ``p`` for every row of ``counts`` (``key``, ``c``): the interpolated probability of its last symbol.

    Orders below the highest use continuation counts: the number of distinct symbols seen before. A history that was
    not seen leaves the lower order's probability as it is; the lowest is interpolated with the uniform distribution.
    """
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        low = F.col("key").bitwiseAND(F.lit((1 << (SYMBOL_BITS * k)) - 1))
        levels[k] = staged(levels[k + 1].groupBy(low.alias("key")).agg(F.sum((F.col("c") > 0).cast("long")).alias("c")), f"grams{k}")
    below: DataFrame | None = None
    for k in range(1, ORDER + 1):
        met = levels[k].agg(*(F.sum((F.col("c") == i).cast("long")) for i in (1, 2, 3, 4))).first()
        d = discounts(*(x or 0 for x in met))
        cut = F.when(F.col("c") == 0, 0.0).when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        rows = levels[k].withColumn("history", F.shiftright("key", SYMBOL_BITS)).withColumn("cut", cut)
        histories = rows.where("c > 0").groupBy("history").agg(F.sum("c").alias("total"), F.sum("cut").alias("freed"))
        lower = F.lit(1.0 / 256)
        joined = rows.join(histories, "history", "left")
        if below is not None:
            low = F.col("key").bitwiseAND(F.lit((1 << (SYMBOL_BITS * (k - 1))) - 1))
            joined = joined.withColumn("suffix", low).join(below.select(F.col("key").alias("suffix"), F.col("p").alias("lower")), "suffix")
            lower = F.col("lower")
        p = F.when(F.col("total") > 0, (F.col("c") - F.col("cut") + F.col("freed") * lower) / F.col("total")).otherwise(lower)
        below = staged(joined.select("key", p.alias("p")), f"probabilities{k}")
    return below


# ---------------------------------------------------------------- scoring


def write_chunks(rows: DataFrame) -> str:
    """``rows`` (``chunk, key, log``; may repeat) as a file of ascending keys for each chunk; returns the folder."""
    folder = scratch(rows.sparkSession, "model")

    def file(rows: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[bytes]:
        index, at, last = [], 0, -1
        for keys, logs in rows:
            new = np.diff(keys, prepend=last) != 0
            last = int(keys[-1])
            if new.any():
                data = pack(keys=keys[new], logs=logs[new])
                index.append((int(keys[new][0]), at, len(data)))
                at += len(data)
                yield data
        table = np.array(index, np.int64).reshape(-1, 3)
        data = pack(first=table[:, 0].copy(), offset=table[:, 1].copy(), bytes=table[:, 2].copy())
        yield data + struct.pack("<Q", len(data))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for batch in batches:
            chunks, keys, logs = (c.to_numpy() for c in batch.columns)
            bounds = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), chunks.size]
            for a, b in zip(bounds, bounds[1:], strict=False):
                if b > a:
                    yield int(chunks[a]), keys[a:b], logs[a:b]

    def pieces(rows: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, size = [], 0
        for _, keys, logs in rows:
            held.append((keys, logs))
            size += keys.size
            if size >= PIECE_ROWS:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
        if held:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))

    def write(batches: Iterator[pa.RecordBatch]):
        done = 0
        for chunk, own in groupby(runs(batches), itemgetter(0)):
            write_whole(_path(folder, chunk), file(pieces(own)))
            done += 1
        yield pa.RecordBatch.from_pydict({"n": [done]})

    dealt = rows.select("chunk", "key", "log").repartition(shuffle_width(rows.sparkSession), "chunk").sortWithinPartitions("chunk", "key")
    dealt.mapInArrow(write, "n long").agg(F.sum("n")).first()
    return folder


def _path(folder: str, chunk: int) -> str:
    return f"{folder}/chunk-{chunk & (1 << 64) - 1:016x}"


class Chunk:
    """The logarithms of a chunk's n-grams, read a piece at a time."""

    def __init__(self, path: str):
        self.path = path
        store, name = open_fs(path)
        with store.open_input_file(name) as f:
            end = f.size()
            f.seek(end - 8)
            size = struct.unpack("<Q", f.read(8))[0]
            f.seek(end - 8 - size)
            self.index = unpack(f.read(size))
        self.piece = lru_cache(maxsize=2)(self._piece)

    def _piece(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        store, name = open_fs(self.path)
        with store.open_input_file(name) as f:
            f.seek(int(self.index["offset"][k]))
            found = unpack(f.read(int(self.index["bytes"][k])))
        return found["keys"], found["logs"]

    def logs(self, keys: np.ndarray) -> np.ndarray:
        """Logarithms for ascending ``keys``; one that the chunk lacks fails."""
        out = np.empty(keys.size, np.float64)
        bounds = [0, *np.searchsorted(keys, self.index["first"][1:]).tolist(), keys.size]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            if b > a:
                own, values = self.piece(k)
                at = np.minimum(np.searchsorted(own, keys[a:b]), own.size - 1)
                if (own[at] != keys[a:b]).any():
                    raise ValueError(f"{self.path} lacks an n-gram of its documents")
                out[a:b] = values[at]
        return out


@lru_cache(maxsize=2)
def _chunk(path: str) -> Chunk:
    return Chunk(path)


def perplexities(df: DataFrame, text: str, folder: str, out: str = "perplexity") -> DataFrame:
    """``df`` (with ``_chunk``) with the perplexity per byte instead of its text; null for empty and null texts.

    A document's logarithms are added up on their own, so that equal texts have equal perplexities.
    """
    kept = [c for c in df.columns if c not in (text, out, "_chunk")]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema]

    def run(batches):
        for chunk, batch, texts in _runs(batches, text):
            keys, lengths = ngram_keys(texts)
            value = np.full(lengths.size, np.nan)
            if keys.size:
                found, inverse = np.unique(keys, return_inverse=True)
                logs = _chunk(_path(folder, chunk)).logs(found)[inverse]
                some = lengths > 0
                sums = np.add.reduceat(logs, (np.cumsum(lengths) - lengths)[some])
                value[some] = np.exp(-sums / lengths[some])
            yield pa.RecordBatch.from_arrays([*(batch.column(i + 1) for i in range(len(kept))), pa.array(value, pa.float64(), mask=lengths == 0)], names=[*kept, out])

    return df.select("_chunk", *kept, text).mapInArrow(run, ", ".join([*fields, f"`{out}` double"]))


def text_hash(text: str = "text") -> Column:
    return F.xxhash64(text_or_empty(text))


def classify(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """``doc_id, text_hash, lang, trusted, perplexity, threshold, keep`` for every row of ``docs``.

    Trusted are documents that ``labels`` (``doc_id``, ``quality``) gives quality 1 and never 0. One in ``HELD_OUT`` of
    them, by a hash of the text so that equal texts stay together, is left out of the fit; the threshold of a language
    is the quantile of its held-out perplexities at every size, of all held-out ones where it has none, and missing
    where there are none at all: then every document with a character is kept. Null and empty texts have no perplexity
    and are not kept. Null languages are a language. Equal texts of a language get equal decisions. Repeated rows stay.

    A document's own n-grams never become rows: those of a chunk do, each once, which the joins need; the perplexity is
    one of bytes.
    """
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("trusted"))
    base = placed(docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text"), text_hash(text).alias("text_hash"), F.col(lang).alias("lang")))
    base = base.join(sized_broadcast(staged(good, "trusted")), "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    held = F.pmod(F.col("text_hash"), F.lit(HELD_OUT)) == 0
    base = base.withColumn("held", held & F.col("trusted")).withColumn("trained", F.col("trusted") & ~held)

    grams = staged(count_ngrams(base, "text", "trained"), "grams")
    table = probabilities(staged(grams.groupBy("key").agg(F.sum("c").alias("c")), "counts"))
    # Where a tiny model has a discount of 0, an n-gram may have no probability at all; its documents are not kept.
    log = F.when(F.col("p") > 0, F.ln("p")).otherwise(F.lit(float("-inf"))).cast("float").alias("log")
    folder = write_chunks(grams.select("chunk", "key").join(table.select("key", log), "key"))
    scored = staged(perplexities(base.select("_chunk", "doc_id", "text_hash", "lang", "trusted", "held", "text"), "text", folder), "scores")

    seen = scored.where("held and perplexity is not null")
    overall = seen.agg(F.percentile_approx("perplexity", quantile, 100_000)).first()[0]
    name = F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("n")).alias("_lang")
    limits = seen.groupBy(name).agg(F.percentile_approx("perplexity", quantile, 100_000).alias("threshold"))
    sizes = scored.groupBy(name).agg(F.count("*").alias("rows"))
    limits = staged(sizes.join(limits, "_lang", "left"), "limits")
    found = lookup(scored.withColumn("_lang", name), limits, "_lang", "rows")
    threshold = F.coalesce("threshold", F.lit(overall).cast("double"))
    keep = F.col("perplexity").isNotNull() & (threshold.isNull() | (F.col("perplexity") <= threshold))
    return found.select("doc_id", "text_hash", "lang", "trusted", "perplexity", threshold.alias("threshold"), keep.alias("keep"))

"""Token ids in binary files, coded by a static range asymmetric numeral system (rANS).

One table of frequencies, counted over all documents, serves every file. A file holds blocks of tokens in document
order; each block interleaves lanes that share one stream of 32-bit words and decodes without any other block. The
footer lists the blocks (the checkpoints: offset, first token, CRC-32 of the ids) and the documents.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import ship
from .files import INDEX, open_fs, pack, read_range, unpack, write_parts, write_whole
from .pretokens import probed_table
from .shared import scratch, shuffle_width, text_batches, text_or_empty
from .slicecache import BATCH_CHARS, SliceCache

MAGIC = b"RANSTOK1"
BLOCK_TOKENS = 1 << 18
LANES = 1024
SCALE_BITS = 20
_LOW = np.uint64(1 << 31)  # states stay in [2^31, 2^63)


# ---------------------------------------------------------------- the coder


def scaled_frequencies(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies that sum to ``2**bits``, at least 1 for every symbol that occurs; all 0 when none does."""
    counts = np.asarray(counts, np.int64)
    total, size = int(counts.sum()), 1 << bits
    if not total:
        return np.zeros(counts.size, np.uint32)
    if np.count_nonzero(counts) > size:
        raise ValueError("more symbols than the table has slots")
    freq = np.where(counts > 0, np.maximum(1, (counts * (size / total)).astype(np.int64)), 0)
    order = np.argsort(-freq, kind="stable")
    short = size - int(freq.sum())
    if short >= 0:
        freq[order[0]] += short
    else:
        for i in order:
            cut = min(-short, int(freq[i]) - 1)
            freq[i] -= cut
            short += cut
            if not short:
                break
    return freq.astype(np.uint32)


class Coder:
    """Encodes and decodes blocks of ids under one frequency table."""

    def __init__(self, freq: np.ndarray, bits: int = SCALE_BITS):
        self.bits = np.uint64(bits)
        self.mask = np.uint64((1 << bits) - 1)
        self.freq = freq.astype(np.uint64)
        self.below = np.cumsum(self.freq) - self.freq
        self.symbol = np.repeat(np.arange(freq.size, dtype=np.uint32), freq.astype(np.int64))
        self.slot_freq = self.freq[self.symbol]
        self.slot_bias = np.arange(self.symbol.size, dtype=np.uint64) - self.below[self.symbol]
        self.top = np.uint64(31 - bits + 32)

    def encode(self, ids: np.ndarray, lanes: int = LANES) -> bytes:
        lanes = max(1, min(lanes, ids.size // 64))
        freq, below = self.freq[ids], self.below[ids]
        if not freq.all():
            raise ValueError("an id is not in the table")
        x = np.full(lanes, _LOW, np.uint64)
        words: list[np.ndarray] = []
        for at in range((ids.size - 1) // lanes * lanes, -1, -lanes):
            f, b = freq[at : at + lanes], below[at : at + lanes]
            s = x[: f.size]
            full = s >= (f << self.top)
            if full.any():
                words.append(s[full].astype(np.uint32))
                s = np.where(full, s >> np.uint64(32), s)
            q = s // f
            x[: f.size] = (q << self.bits) + (s - q * f) + b
        stream = np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)
        return struct.pack("<II", lanes, stream.size) + x.astype("<u8").tobytes() + stream.astype("<u4").tobytes()

    def decode(self, data: bytes, n: int) -> np.ndarray:
        lanes, size = struct.unpack_from("<II", data)
        x = np.frombuffer(data, "<u8", lanes, 8).astype(np.uint64)
        words = np.frombuffer(data, "<u4", size, 8 + 8 * lanes).astype(np.uint64)
        out, p = np.empty(n, np.uint32), 0
        for at in range(0, n, lanes):
            r = min(lanes, n - at)
            slot = x[:r] & self.mask
            out[at : at + r] = self.symbol[slot]
            s = self.slot_freq[slot] * (x[:r] >> self.bits) + self.slot_bias[slot]
            low = np.flatnonzero(s < _LOW)
            s[low] = (s[low] << np.uint64(32)) | words[p : p + low.size]
            p += low.size
            x[:r] = s
        if p != size or not (x == _LOW).all():
            raise ValueError("a block is damaged")
        return out


def write_table(freq: np.ndarray, uri: str) -> None:
    body = struct.pack("<II", SCALE_BITS, freq.size) + freq.astype("<u4").tobytes()
    write_whole(uri, [MAGIC, body, struct.pack("<I", zlib.crc32(body))])


@lru_cache(maxsize=2)
def read_table(uri: str) -> Coder:
    data = read_range(uri)
    body = data[8:-4]
    if data[:8] != MAGIC or zlib.crc32(body) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError(f"{uri} is no frequency table")
    bits, _ = struct.unpack_from("<II", body)
    return Coder(np.frombuffer(body, "<u4", offset=8), bits)


# ---------------------------------------------------------------- files


def encode_file(parts: Iterable[dict[str, np.ndarray]], coder: Coder) -> Iterator[bytes]:
    """A file's bytes from runs of documents: arrays ``doc_id``, ``valid``, ``n`` and their ids laid end to end."""
    yield MAGIC
    offset, first = len(MAGIC), 0
    docs: list[dict[str, np.ndarray]] = []
    blocks: list[tuple[int, int, int, int, int]] = []
    held: list[np.ndarray] = []
    size = 0

    def flush(ids: np.ndarray) -> bytes:
        nonlocal offset, first
        data = coder.encode(ids)
        blocks.append((offset, len(data), first, ids.size, zlib.crc32(ids.astype("<u4").tobytes())))
        offset, first = offset + len(data), first + ids.size
        return data

    for part in parts:
        docs.append({k: part[k] for k in ("doc_id", "valid", "n")})
        held.append(part["ids"])
        size += part["ids"].size
        if size >= BLOCK_TOKENS:
            ids = np.concatenate(held)
            whole = size // BLOCK_TOKENS * BLOCK_TOKENS
            for at in range(0, whole, BLOCK_TOKENS):
                yield flush(ids[at : at + BLOCK_TOKENS])
            held, size = [ids[whole:]], size - whole
    if size:
        yield flush(np.concatenate(held))
    table = np.array(blocks, np.int64).reshape(-1, 5)
    joined = {k: np.concatenate([d[k] for d in docs]) if docs else np.empty(0, np.int64) for k in ("doc_id", "valid", "n")}
    footer = pack(**joined, **{k: np.ascontiguousarray(table[:, i]) for i, k in enumerate(("offset", "bytes", "first", "tokens", "crc"))})
    yield footer + struct.pack("<Q", len(footer)) + MAGIC


def read_footer(uri: str) -> dict[str, np.ndarray]:
    store, path = open_fs(uri)
    with store.open_input_file(path) as f:
        end = f.size()
        f.seek(end - 16)
        n, magic = struct.unpack("<Q8s", f.read(16))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token file")
        f.seek(end - 16 - n)
        return unpack(f.read(n))


def read_tokens(uri: str, coder: Coder, start: int = 0, stop: int | None = None) -> Iterator[np.ndarray]:
    """Ids ``start`` to ``stop`` of a file, a block at a time; only the blocks that hold them are read."""
    footer = read_footer(uri)
    store, path = open_fs(uri)
    with store.open_input_file(path) as f:
        for offset, size, first, n, crc in zip(*(footer[k].tolist() for k in ("offset", "bytes", "first", "tokens", "crc")), strict=True):
            if first + n <= start or (stop is not None and first >= stop):
                continue
            f.seek(offset)
            ids = coder.decode(f.read(size), n)
            if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
                raise ValueError(f"{uri}: the block of token {first} is damaged")
            yield ids[max(0, start - first) : None if stop is None else max(0, stop - first)]


# ---------------------------------------------------------------- tokenizer


class LibraryEncoder:
    """Whole texts by a file of the tokenizers library, as it encodes them without adding special tokens.

    Where the file splits texts by the byte-level pattern and changes them in no other way, each distinct slice goes
    through the library's model once and is kept; texts that hold an added token (special ones among them), and all
    texts of any other file, go through the library one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        self.cache = SliceCache(self._slice, probed_table(self._joined)) if plain and not spec.get("normalizer") and spec["model"]["type"] == "BPE" else None
        added = [t["content"] for t in spec.get("added_tokens") or [] if t["content"]]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}

    def _joined(self, pairs: list[str]) -> list[bool]:
        # A line feed stays apart from a letter or number before it.
        text = "\n".join(pairs)
        whole = {a // 3 for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text) if b - a == 2 and text[a] != "\n"}
        return [i in whole for i in range(len(pairs))]

    def _slice(self, piece: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(piece.encode("utf-8", "replace").decode("latin-1").translate(self.letters))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.cache is None:
            return self._whole(texts)
        marked = [i for i, t in enumerate(texts) if self.added is not None and self.added.search(t)]
        if not marked:
            return self.cache.encode(texts)
        apart = set(marked)
        ids, counts = self.cache.encode(["" if i in apart else t for i, t in enumerate(texts)])
        own, sizes = self._whole([texts[i] for i in marked])
        ids = np.insert(ids, np.repeat(np.cumsum(counts)[marked], sizes), own)
        counts[marked] = sizes
        return ids, counts

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.int32, int(counts.sum())), counts


@lru_cache(maxsize=1)
def _encoder(name: str) -> LibraryEncoder:
    return LibraryEncoder(SparkFiles.get(name))


# ---------------------------------------------------------------- the operator


def write_token_files(df: DataFrame, tokenizer_path: str, folder: str, *, key: str = "doc_id", text: str = "text", end_id: int | None = 0) -> list[dict]:
    """Encode all texts, append ``end_id`` to each, and write coded files in ascending order of ``key``.

    Returns the index, one entry a file: ``part``, ``path``, ``bytes``, ``rows``, ``units`` (tokens) and ``start``
    (tokens in all files before). A null text is empty; rows with a null key come first, rows with one key in the
    order of their texts' 64-bit hashes, then of the texts. No row gives no file. Only files' names and sums reach the
    driver, and the counts of the vocabulary's ids. The rows of one key, even of one key and text, are dealt to as many
    files as ranges of key, hash and row number make of them.

    The texts are dealt by key ranges and encoded once, into plain files that also hold the id counts; the counts are
    summed by a job; then each plain file becomes a coded one. Every file's name depends only on its partition.
    """
    spark = df.sparkSession
    name = ship(df, tokenizer_path)
    width = shuffle_width(spark)

    def plain(batches, facts):
        encoder, counts = _encoder(name), np.zeros(0, np.int64)
        for batch, texts in text_batches(batches, text, BATCH_CHARS):
            ids, n = encoder.encode(texts)
            if end_id is not None:
                ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
            keys = batch.column(0)
            seen = np.bincount(ids, minlength=counts.size)
            seen[: counts.size] += counts
            counts = seen
            facts["rows"] += n.size
            facts["units"] += ids.size
            small = ids.astype(np.uint16 if not ids.size or int(ids.max()) < 1 << 16 else np.uint32)
            data = pack(doc_id=keys.fill_null(0).to_numpy(zero_copy_only=False), valid=keys.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8), n=n, ids=small)
            yield struct.pack("<BQ", 1, len(data)) + data
        data = pack(counts=counts)
        yield struct.pack("<BQ", 2, len(data)) + data

    value = text_or_empty(text)
    source = df.select(F.col(key).cast("long").alias("_key"), value.alias(text), F.xxhash64(value).alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    order = [F.col("_key").asc_nulls_first(), F.col("_hash")]
    dealt = source.repartitionByRange(width, *order, F.col("_row")).sortWithinPartitions(*order, text).select("_key", text)
    raw = write_parts(dealt, f"{folder}/plain", ".ids", plain)

    counted = _per_file(spark, raw, _count_rows, "id int, count long").groupBy("id").agg(F.sum("count").alias("count")).collect()
    counts = np.zeros(max((r["id"] for r in counted), default=0) + 1, np.int64)
    for r in counted:
        counts[r["id"]] = r["count"]
    table = f"{folder}/table.bin"
    write_table(scaled_frequencies(counts), table)

    def coded(entry):
        path = f"{folder}/part-{entry['part']:06d}.rans"
        size = write_whole(path, encode_file(_plain_parts(entry["path"]), read_table(table)))
        yield pa.RecordBatch.from_pylist([entry | {"path": path, "bytes": size}], schema=INDEX)

    written = {r["part"]: r.asDict() for r in _per_file(spark, raw, coded, "part int, path string, bytes long, rows long, units long").collect()}
    store, path = open_fs(f"{folder}/plain")
    if raw:
        store.delete_dir(path)
    out, start = [], 0
    for part in sorted(written):
        out.append(written[part] | {"start": start})
        start += written[part]["units"]
    return out


def read_token_files(spark: SparkSession, folder: str, index: list[dict]) -> DataFrame:
    """The documents of the files: ``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` (of little-endian 32-bit ids)."""
    table = f"{folder}/table.bin"

    def read(entry):
        footer, coder = read_footer(entry["path"]), read_table(table)
        n = footer["n"]
        crc, done = np.zeros(n.size, np.int64), 0
        ends, at, value, doc = np.cumsum(n), 0, 0, 0
        for ids in read_tokens(entry["path"], coder):
            data, base = memoryview(ids.astype("<u4").tobytes()), at
            at += ids.size
            while doc < n.size and ends[doc] <= at:
                crc[doc] = zlib.crc32(data[4 * max(0, done - base) : 4 * (int(ends[doc]) - base)], value)
                done, value, doc = int(ends[doc]), 0, doc + 1
            if done < at:
                value = zlib.crc32(data[4 * max(0, done - base) :], value)
        if doc != n.size or at != entry["units"]:
            raise ValueError(f"{entry['path']} is not whole")
        yield pa.RecordBatch.from_arrays(
            [pa.array(footer["doc_id"], pa.int64(), mask=footer["valid"] == 0), pa.array(entry["start"] + ends - n, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )

    return _per_file(spark, index, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(df: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write token files into a new scratch folder and return the documents as read back from them."""
    folder = scratch(df.sparkSession, "tokens")
    return read_token_files(df.sparkSession, folder, write_token_files(df, tokenizer_path, folder, **options))


def _plain_parts(uri: str) -> Iterator[dict[str, np.ndarray]]:
    yield from (part for kind, part in _sections(uri) if kind == 1)


def _sections(uri: str) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    store, path = open_fs(uri)
    with store.open_input_file(path) as f:
        while head := f.read(9):
            kind, size = struct.unpack("<BQ", head)
            yield kind, unpack(f.read(size))


def _count_rows(entry: dict) -> Iterator[pa.RecordBatch]:
    for kind, part in _sections(entry["path"]):
        if kind == 2:
            found = np.flatnonzero(part["counts"])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(part["counts"][found], pa.int64())], names=["id", "count"])


def _per_file(spark: SparkSession, entries: list[dict], fn, schema: str) -> DataFrame:
    """``fn(entry)`` for each file in a task of its own."""
    n = len(entries)

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield from fn(entries[k])

    return spark.range(0, n, 1, max(1, n)).mapInArrow(run, schema)

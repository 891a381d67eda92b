"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by offsets into the vocabulary's bytes."""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from .pretokens import probed_table
from .shared import byte_slices, text_batches
from .slicecache import BATCH_CHARS, SliceCache, gather

# Fixed value: the pattern that slices texts, as the public library takes it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Vocabulary:
    """Ranks of byte strings (a rank file: base64 and rank in each line), and the texts' encoder on top of them."""

    def __init__(self, data: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}
        by_rank = sorted(self.ranks.items(), key=lambda x: x[1])
        size = by_rank[-1][1] + 1 if by_rank else 0
        self.lengths = np.zeros(size, np.int64)
        for piece, rank in by_rank:
            self.lengths[rank] = len(piece)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(piece for piece, _ in by_rank), np.uint8)
        self.cache = SliceCache(lambda piece: merge(piece.encode("utf-8", "replace"), self.ranks), probed_table(_joined))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts laid end to end, and the number of ids of each."""
        return self.cache.encode(texts)

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of each id; an id that is not in the vocabulary fails."""
        if ids.size and (int(ids.min()) < 0 or int(ids.max()) >= self.lengths.size or not self.lengths[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        return self.lengths[ids]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids laid end to end, and the offset behind each id's bytes."""
        self.sizes(ids)
        return gather(self.blob, self.offsets, self.lengths, ids)


def _joined(pairs: list[str]) -> list[bool]:
    """Whether the pattern keeps two-letter texts in one slice, by the public library's own engine.

    Its probe vocabulary merges the first letter with the next byte, which happens only within a slice.
    """
    pieces = [bytes([b]) for b in range(256)] + [p.encode() + bytes([b]) for p in {p[0] for p in pairs} for b in range(0x80, 0x100)]
    probe = tiktoken.Encoding("probe", pat_str=PATTERN, mergeable_ranks={p: i for i, p in enumerate(pieces)}, special_tokens={})
    return [len(ids) < 1 + len(pair[1:].encode()) for pair, ids in zip(pairs, map(probe.encode_ordinary, pairs), strict=True)]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the adjacent pair of least rank merges first, the leftmost of equals."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > 48:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    none = 1 << 60
    pairs = [ranks.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs:
        least = min(pairs)
        if least == none:
            break
        i = pairs.index(least)
        parts[i : i + 2] = [both := parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + both, none)
        if i < len(pairs):
            pairs[i] = ranks.get(both + parts[i + 1], none)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap and a linked list, n log n in the slice's length."""
    n = len(piece)
    stop = list(range(1, n + 1))  # end of the part that starts here
    before = list(range(-1, n - 1))
    alive = bytearray(b"\1") * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and stop[i] < n:
            end = stop[stop[i]]
            rank = ranks.get(piece[i:end])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end))

    for i in range(n):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or stop[i] >= n or stop[stop[i]] != end:
            continue
        alive[stop[i]] = 0
        stop[i] = end
        if end < n:
            before[end] = i
        offer(before[i])
        offer(i)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : stop[i]]])
        i = stop[i]
    return out


@lru_cache(maxsize=2)
def _vocabulary(name: str) -> Vocabulary:
    with open(SparkFiles.get(name), "rb") as f:
        return Vocabulary(f.read())


def ship(df: DataFrame, path: str) -> str:
    """Send a small vocabulary file to every executor, once; returns the name it has there."""
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode(df: DataFrame, ranks_path: str, *, text: str = "text", ids: str = "ids", offsets: str | None = None, decoded: str | None = None) -> DataFrame:
    """``df`` with an ``array<int>`` column of ids for its whole texts, and on request each token's end in bytes and the
    bytes that the ids decode to, made in the same task.

    A null text counts as empty and gives an empty array. Rows, their order in a partition and all other columns stay;
    an existing column of the output's name is replaced. Texts of any length are held whole; no special tokens.
    """
    name = ship(df, ranks_path)
    kept = [c for c in df.columns if c not in (ids, offsets, decoded)]
    out = df.select(*kept).limit(0)
    more = [*([f"`{offsets}` array<int>"] if offsets else []), *([f"`{decoded}` binary"] if decoded else [])]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema), f"`{ids}` array<int>", *more])

    def run(batches):
        vocabulary = _vocabulary(name)
        for batch, texts in text_batches(batches, text, BATCH_CHARS):
            flat, counts = vocabulary.encode(texts)
            bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            made = {ids: pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))}
            if offsets:
                ends = np.cumsum(vocabulary.lengths[flat])
                base = np.concatenate([[0], ends])[bounds]
                made[offsets] = pa.ListArray.from_arrays(pa.array(bounds), pa.array((ends - np.repeat(base[:-1], counts)).astype(np.int32)))
            if decoded:
                made[decoded] = _bytes(vocabulary, flat, bounds)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made.values()], names=[*kept, *made])

    return df.select(*{*kept, text}).mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, *, ids: str = "ids", offsets: str | None = None, out: str = "decoded") -> DataFrame:
    """``df`` with the bytes of its ids (null ids: empty); an id that the vocabulary lacks fails the job.

    ``offsets``: a column of each token's end in bytes, as ``encode`` gives it. Every token's bytes then go where its
    end says; ends that do not fit the tokens fail the job.
    """
    name = ship(df, ranks_path)
    kept = [c for c in df.columns if c != out]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema), f"`{out}` binary"])

    def run(batches):
        vocabulary = _vocabulary(name)
        for batch in batches:
            lists = _lists(batch.column(kept.index(ids)))
            counts = np.diff(lists.offsets.to_numpy())
            for start, stop in byte_slices(counts * 8, BATCH_CHARS):
                part = batch.slice(start, stop - start)
                flat = lists.slice(start, stop - start).flatten().to_numpy(zero_copy_only=False)
                n = np.concatenate([[0], np.cumsum(counts[start:stop])])
                sizes = vocabulary.sizes(flat)
                ends = np.cumsum(sizes)
                bounds = np.concatenate([[0], ends])[n].astype(np.int64)
                if offsets:
                    own = _lists(part.column(kept.index(offsets))).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                    if own.size != flat.size or not np.array_equal(own + np.repeat(bounds[:-1], np.diff(n)), ends):
                        raise ValueError("the offsets do not fit the tokens")
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), _bytes(vocabulary, flat, n)], names=[*kept, out])

    return df.select(*kept).mapInArrow(run, schema)


def _bytes(vocabulary: Vocabulary, flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of each row's ids; ``bounds``: where the rows' ids begin and end."""
    data, ends = vocabulary.decode(flat)
    at = np.concatenate([[0], ends])[bounds].astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), bounds.size - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).cast(pa.binary())


def _lists(column: pa.ListArray) -> pa.ListArray:
    return column.fill_null([]) if column.null_count else column

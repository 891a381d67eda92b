"""Slices of texts to ids through a cache, whole batches at a time: found by hash, compared by their code points."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import pretokens

#: Entries, and code points of them, that a process keeps before the cache starts anew (results do not depend on it).
MAX_ENTRIES, MAX_POINTS = 400_000, 4_000_000
#: Code points a batch is cut to (a longer single text is a batch of its own).
BATCH_CHARS = 500_000

_BASE = 0x9E3779B97F4A7C15
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if "up" not in _tables or _tables["up"].size < n:
        n = max(n, BATCH_CHARS + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _tables[name] = np.cumprod(factors)
    return _tables["up"], _tables["down"]


def _values() -> np.ndarray:
    """A random odd number for every code point."""
    if "values" not in _tables:
        _tables["values"] = np.random.default_rng(20_24).integers(0, 1 << 63, 0x110000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return _tables["values"]


def slice_hashes(points: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Polynomial hash modulo 2^64 of every slice, from one prefix sum.

    Different slices can be made to share a hash, so that a caller compares what it finds by it.
    """
    up, down = _powers(points.size)
    sums = np.zeros(points.size + 1, np.uint64)
    np.cumsum(_values()[points] * up[: points.size], out=sums[1:])
    return (sums[stops] - sums[starts]) * down[starts]


def gather(blob: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``which`` of a ragged table laid end to end, and where each ends."""
    n = lengths[which]
    ends = np.cumsum(n)
    total = int(ends[-1]) if ends.size else 0
    kind = np.int32 if max(total, blob.size) < 2**31 else np.int64
    at = np.arange(total, dtype=kind)
    at += np.repeat((offsets[which] - (ends - n)).astype(kind), n)
    return blob[at], ends


class SliceCache:
    """Ids of slices; ``resolve`` gives the ids of a slice that is met for the first time.

    A slice is looked up by its hash and compared with the cached one code point by code point; a slice that shares
    its hash with another one is kept by its text.
    """

    def __init__(self, resolve: Callable[[str], list[int]], classes: np.ndarray | None = None):
        self.resolve, self.classes = resolve, classes
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.slot = np.empty(0, np.int64)
        self.ids = Ragged(np.int32)
        self.points = Ragged(np.uint32)
        self.twins: dict[str, int] = {}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts laid end to end (int32), and the number of ids of each text."""
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        starts = pretokens.slice_starts(points, ends, self.classes)
        cut = np.searchsorted(starts, ends)  # each separator's own slice
        stops = np.append(starts[1:], points.size)
        real = np.ones(starts.size, bool)
        real[cut] = False
        starts, stops = starts[real], stops[real]
        if not starts.size:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        hashes, first, inverse = np.unique(slice_hashes(points, starts, stops), return_index=True, return_inverse=True)
        if self.ids.lengths.size > MAX_ENTRIES or self.points.flat.size > MAX_POINTS:
            self.clear()
        at = np.searchsorted(self.keys, hashes)
        known = at < self.keys.size
        known[known] = self.keys[at[known]] == hashes[known]
        if not known.all():
            slots = self._add(joined, points, starts[first[~known]], stops[first[~known]])
            where = np.searchsorted(self.keys, hashes[~known])
            self.keys = np.insert(self.keys, where, hashes[~known])
            self.slot = np.insert(self.slot, where, slots)
            at = np.searchsorted(self.keys, hashes)
        which = self.slot[at][inverse.reshape(-1)]
        for k in np.flatnonzero(self._differ(points, starts, stops, which)).tolist():
            piece = joined[starts[k] : stops[k]]
            if piece not in self.twins:
                self.twins[piece] = int(self._add(joined, points, starts[k : k + 1], stops[k : k + 1])[0])
            which[k] = self.twins[piece]
        ids, id_ends = gather(self.ids.flat, self.ids.offsets, self.ids.lengths, which)
        bounds = np.concatenate([[0], id_ends])[cut - np.arange(cut.size)]
        return ids, np.diff(bounds, prepend=0)

    def _differ(self, points: np.ndarray, starts: np.ndarray, stops: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Whether a slice's code points are other than those of the entry found for it."""
        lengths = stops - starts
        wrong = self.points.lengths[which] != lengths
        same = np.flatnonzero(~wrong)
        if same.size:
            kept, ends = gather(self.points.flat, self.points.offsets, self.points.lengths, which[same])
            own, _ = gather(points, starts, lengths, same)
            other = kept != own
            if other.any():
                wrong[same] = np.add.reduceat(other, ends - lengths[same]) > 0
        return wrong

    def _add(self, joined: str, points: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Resolve and keep slices; their places in the tables."""
        found = [self.resolve(joined[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        slots = self.ids.append(np.fromiter((x for ids in found for x in ids), np.int32, int(lengths.sum())), lengths)
        self.points.append(gather(points, starts, stops - starts, np.arange(starts.size))[0], stops - starts)
        return slots


class Ragged:
    """Lists of numbers laid end to end."""

    def __init__(self, kind: type):
        self.flat = np.empty(0, kind)
        self.offsets = np.empty(0, np.int64)
        self.lengths = np.empty(0, np.int64)

    def append(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        slots = np.arange(self.lengths.size, self.lengths.size + lengths.size)
        self.offsets = np.append(self.offsets, self.flat.size + np.cumsum(lengths) - lengths)
        self.lengths = np.append(self.lengths, lengths)
        self.flat = np.append(self.flat, flat)
        return slots

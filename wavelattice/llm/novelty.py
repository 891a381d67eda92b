"""Secret scans: fixed kinds by pattern, and strings that stay incompressible in a sensitive context.

A candidate's novelty is the number of bytes that it adds to the zstandard frame of its surroundings, under a
dictionary of the corpus' own identifiers, divided by its length.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_batches

# The patterns of the fixed kinds, in their order, and the least length of what counts.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ["assign", "access", "hex", "novel"]

# Words that make a context sensitive.
SENSITIVE = r"password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_ -]?key|credential|auth|bearer|session|signature"

#: Length of candidates, and code points on either side that count as surroundings.
LEAST_CANDIDATE, AROUND = 16, 384
#: Characters of candidates, and strings of surroundings that give no word to the dictionary.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
ODD = rf"(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{{{LEAST_CANDIDATE},}}"
#: Different words that a task counts before it hands them on.
COUNTED = 200_000
#: Behind every end of a span.
LAST = 1 << 62
#: Words of the identifier dictionary: a fixed size, so that it fits into every task.
DICTIONARY_WORDS = 4096
#: Bytes that a candidate must add for each of its characters.
NOVELTY = 0.66

_assign = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
_access = re.compile(f"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}")
_hex = re.compile(f"[0-9a-f]{{{LEAST['hex']},}}")
# The last line of an armoured block is a candidate at any length.
_candidate = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_CANDIDATE},}}|(?<=\n)[A-Za-z0-9+/=]{{1,{LEAST_CANDIDATE - 1}}}(?=\r?\n-----END )")
_odd, _word, _run = re.compile(ODD), re.compile("[A-Za-z_]{4,24}"), re.compile(r"\S+")
_sensitive = re.compile(SENSITIVE, re.ASCII | re.IGNORECASE)


def base_spans(text: str, longest: int) -> list[tuple[str, int, int]]:
    """Spans of the fixed kinds. ``longest``: length of the text's longest run without white space."""
    out = []
    if "=" in text or ":" in text:
        out += [("assign", m.start(), m.end()) for m in _assign.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if longest >= LEAST["access"] and "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _access.finditer(text)]
    if longest >= LEAST["hex"]:
        out += [("hex", m.start(), m.end()) for m in _hex.finditer(text)]
    return out


#: What is known of a candidate, in bits.
NEAR, LINKED, HELD, HOLDS = 1, 2, 4, 8


class Candidates:
    """Places and flags of long strings, in the text's order: 17 bytes each, whatever stands around them."""

    def __init__(self) -> None:
        self.start, self.end, self.flags = array("q"), array("q"), bytearray()

    def __len__(self) -> int:
        return len(self.start)

    def append(self, start: int, end: int, flags: int) -> None:
        self.start.append(start)
        self.end.append(end)
        self.flags.append(flags)

    def cut(self, size: int) -> None:
        del self.start[size:], self.end[size:], self.flags[size:]


def candidates(text: str, longest: int, taken: list[tuple[str, int, int]]) -> Candidates:
    """Long strings in chains with a sensitive word somewhere near.

    ``NEAR``: a sensitive word stands in the string or its surroundings. ``LINKED``: the string follows the one before
    on the same or the next line, within the surroundings, so that either carries its context to the other. ``HELD``:
    it lies wholly inside a span of a fixed kind and is not reported again. ``HOLDS``: it goes beyond a key or hex run
    that it holds, and is a secret with it.
    """
    out = Candidates()
    if longest < LEAST_CANDIDATE:
        return out
    # Spans of one kind do not overlap: the last that begins at or before a place, or the first at or behind it, tells.
    fixed = {kind: [(s, e) for k, s, e in taken if k == kind] for kind in KINDS[:3]}
    chain, telling = 0, False
    for m in _candidate.finditer(text):
        a, b = m.span()
        linked = len(out) > chain and a - out.end[-1] <= AROUND and text.count("\n", out.end[-1], a) <= 1
        if not linked:
            if not telling:
                out.cut(chain)
            chain, telling = len(out), False
        near = bool(_sensitive.search(text, max(0, a - AROUND), b + AROUND))
        held = any(k and own[k - 1][1] >= b for own in fixed.values() for k in (bisect_right(own, (a, LAST)),))
        holds = any(k < len(own) and own[k][1] <= b for kind, own in fixed.items() if kind != "assign" for k in (bisect_left(own, (a, 0)),))
        out.append(a, b, near * NEAR | linked * LINKED | held * HELD | holds * HOLDS)
        telling = telling or near
    if not telling:
        out.cut(chain)
    return out


def in_context(found: Candidates, hits: bytearray) -> bytearray:
    """Which of a text's candidates are hits near a sensitive word, or within ``AROUND`` of such a one of their chain."""
    out = bytearray(h and bool(f & NEAR) for h, f in zip(hits, found.flags, strict=True))
    last = None
    for i in range(len(found)):
        last = last if found.flags[i] & LINKED else None
        out[i] = out[i] or (hits[i] and last is not None and found.start[i] - last <= AROUND)
        last = found.end[i] if out[i] else last
    last = None
    for i in range(len(found) - 1, -1, -1):
        out[i] = out[i] or (hits[i] and last is not None and last - found.end[i] <= AROUND)
        last = found.start[i] if out[i] else last
        last = last if found.flags[i] & LINKED else None
    return out


def surrounding_words(text: str, found: Candidates) -> Iterator[list[str]]:
    """The words around each candidate that no fixed span holds.

    Strings with digits, and what the cut at ``AROUND`` leaves of them, are neighbours' secrets rather than identifiers.
    """
    for a, b, flags in zip(found.start, found.end, found.flags, strict=True):
        if not flags & HELD:
            before, after = text[max(0, a - AROUND) : a], text[b : b + AROUND]
            before = before.lstrip(LETTERS) if len(before) == AROUND else before
            after = after.rstrip(LETTERS) if len(after) == AROUND else after
            yield _word.findall(_odd.sub(" ", f"{before} {after}"))


class Novelty:
    """Marginal compressed bytes under a raw-content dictionary."""

    def __init__(self, words: list[str]):
        data = " ".join(words).encode("utf-8", "replace")
        primed = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(data) >= 8 else None
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False)

    def __call__(self, before: str, string: str, after: str) -> float:
        size = lambda s: len(self.compressor.compress(s.encode("utf-8", "replace")))
        return max(0, size(before + after + "\n" + string) - size(before + after + "\n")) / len(string)


SPAN = "struct<kind:string,start:int,end:int,novelty:double>"


def scan(df: DataFrame, *, text: str = "text", spans: str = "spans", threshold: float = NOVELTY) -> DataFrame:
    """``df`` without its text, with an array of spans (code points, end exclusive), by start and then kind.

    Kinds: ``assign``, ``access``, ``hex`` (fixed) and ``novel`` (method: a sensitive word on either side, or next to
    another one on the same or an adjacent line). Null and empty texts have no spans; equal
    texts have equal spans; every row stays, repeated ones too. All other columns are kept, one named like the output
    is replaced. The texts are read twice: for the dictionary, the most frequent words of all surroundings (at most
    ``DICTIONARY_WORDS``, ties by the word), and for the spans. A candidate is held as its place, and its surroundings
    are read from the text, so that a text of nothing but candidates takes little more than itself.
    """
    kept = [c for c in df.columns if c not in (text, spans)]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema]

    def count(batches):
        words: Counter[str] = Counter()
        for _, texts in text_batches(batches, text):
            for t in texts:
                _, loose = _found(t)
                for some in surrounding_words(t, loose):
                    words.update(some)
                    if len(words) >= COUNTED:
                        yield _counts(words)
                        words = Counter()
        yield _counts(words)

    words = df.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = [r.word for r in words.orderBy(F.desc("n"), "word").limit(DICTIONARY_WORDS).collect()]
    top.reverse()  # the most frequent words lie nearest, where references are cheapest

    def measure(batches):
        novelty = Novelty(top)
        for batch, texts in text_batches(batches, text):
            out = Spans()
            for t in texts:
                fixed, loose = _found(t)
                values, hits = array("d"), bytearray()
                for a, b, flags in zip(loose.start, loose.end, loose.flags, strict=True):
                    values.append(0.0 if flags & HELD else novelty(t[max(0, a - AROUND) : a], t[a:b], t[b : b + AROUND]))
                    hits.append(bool(flags & (HELD | HOLDS)) or values[-1] >= threshold)
                out.add(fixed, loose, values, in_context(loose, hits))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), out.column()], names=[*kept, spans])

    return df.select(*kept, text).mapInArrow(measure, ", ".join([*fields, f"`{spans}` array<{SPAN}>"]))


def _found(text: str) -> tuple[list[tuple[str, int, int]], Candidates]:
    longest = max((m.end() - m.start() for m in _run.finditer(text)), default=0)
    fixed = base_spans(text, longest)
    return fixed, candidates(text, longest, fixed)


def _counts(words: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], names=["word", "n"])


class Spans:
    """Spans of texts, as columns."""

    def __init__(self) -> None:
        self.ends, self.kind, self.start, self.end, self.novelty = array("i", [0]), bytearray(), array("i"), array("i"), array("d")

    def add(self, fixed: list[tuple[str, int, int]], loose: Candidates, values: array, reported: bytearray) -> None:
        own = [(a, KINDS.index(k), b, math.nan) for k, a, b in fixed]
        own += [(loose.start[i], len(KINDS) - 1, loose.end[i], values[i]) for i in range(len(loose)) if reported[i] and not loose.flags[i] & HELD]
        for a, k, b, value in sorted(own, key=lambda s: s[:2]):
            self.start.append(a)
            self.kind.append(k)
            self.end.append(b)
            self.novelty.append(value)
        self.ends.append(len(self.start))

    def column(self) -> pa.Array:
        kind = pa.array(KINDS).take(pa.array(np.frombuffer(self.kind, np.uint8)))
        numbers = [pa.array(np.frombuffer(c, np.int32)) for c in (self.start, self.end)]
        rows = pa.StructArray.from_arrays([kind, *numbers, pa.array(np.frombuffer(self.novelty, float), from_pandas=True)], fields=list(_SPANS.value_type))
        return pa.ListArray.from_arrays(pa.array(np.frombuffer(self.ends, np.int32)), rows).cast(_SPANS)


def redact(df: DataFrame, *, text: str = "text", spans: str = "spans", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every span of its text replaced by ``mark``; overlapping spans get one. Null texts stay null."""
    kept = [c for c in df.columns if c != text]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept, text).schema]

    def run(batches):
        for batch in batches:
            out = []
            for value, found in zip(batch.column(len(kept)).to_pylist(), batch.column(kept.index(spans)).to_pylist(), strict=True):
                if value is not None and found:
                    parts, end = [], 0
                    for s in found:
                        if s["start"] >= end:
                            parts += [value[end : s["start"]], mark]
                        end = max(end, s["end"])
                    value = "".join([*parts, value[end:]])
                out.append(value)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(out, pa.string())], names=[*kept, text])

    return df.select(*kept, text).mapInArrow(run, ", ".join(fields))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("novelty", pa.float64())]))

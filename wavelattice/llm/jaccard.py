"""Join of documents whose sets of word n-grams are alike: MinHash candidates, Bayesian pruning, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .files import Writer, pack, read_range, unpack
from .shared import located, lookup, scratch, shuffle_width, sized_broadcast, staged, text_batches, text_or_empty
from .slicecache import gather, slice_hashes

WORDS, THRESHOLD = 5, (4, 5)  # words of an n-gram; least similarity, as a fraction
BANDS, ROWS = 28, 5  # a pair at the threshold shares no band with a chance of 2 in 100,000
FIRST_BANDS = 6  # bands of the first round; later ones only compare what is not linked yet
STEP = 20  # MinHash values compared at a time
TOLERANCE = 1e-6
BLOCK = 512  # signatures of a bucket that a task compares with as many others
TEXT_BLOCK, TEXT_BYTES = 256, 1 << 19  # texts of a group, and their bytes, that a task compares with as many others
BATCH_CHARS = 500_000
PAIRS = 1 << 16  # pairs compared at a time

_P = np.uint64(0x9E3779B185EBCA87)
_WHITE = np.array([chr(c).isspace() for c in range(0x3002)])


def _word_slices(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, starts and ends of their words (what white space parts), and words of each text.

    Words are slices of one array; no word becomes an object of its own.
    """
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    white = _WHITE[np.minimum(points, 0x3001)]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], white]).view(np.int8)))
    starts, stops = edges[::2], edges[1::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    return points, starts, stops, np.diff(np.searchsorted(starts, ends), prepend=0)


def _filled(words: np.ndarray, lengths: np.ndarray, filler) -> tuple[np.ndarray, np.ndarray]:
    """Words with fillers behind those of texts that have fewer than ``WORDS``, and the new lengths."""
    short = np.flatnonzero((lengths > 0) & (lengths < WORDS))
    if short.size:
        lack = WORDS - lengths[short]
        words = np.insert(words, np.repeat(np.cumsum(lengths)[short], lack), filler)
        lengths = lengths.copy()
        lengths[short] = WORDS
    return words, lengths


def _starts_of_ngrams(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words begin an n-gram, and the n-grams of each text."""
    counts = np.maximum(lengths - (WORDS - 1), 0)
    place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return place < np.repeat(counts, lengths), counts


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of words, text by text, and their number in each; only candidates are found by them.

    A text of fewer words has one n-gram, of all of them; a text without words has none.
    """
    points, starts, stops, lengths = _word_slices(texts)
    hashes = slice_hashes(points, starts, stops)
    if not hashes.size:
        return hashes, lengths
    hashes, lengths = _filled(hashes, lengths, np.uint64(1))
    out = np.zeros(hashes.size, np.uint64)
    for k in range(WORDS):
        out[: out.size - k] = out[: out.size - k] * _P + hashes[k:]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    begins, counts = _starts_of_ngrams(lengths)
    return out[begins], counts


def numbered_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number for every word, equal for equal words and no others, and the words of each text."""
    points, starts, stops, lengths = _word_slices(texts)
    if not starts.size:
        return np.empty(0, np.int64), lengths
    _, first, numbers = np.unique(slice_hashes(points, starts, stops), return_index=True, return_inverse=True)
    numbers, sizes = numbers.reshape(-1), stops - starts
    like = first[numbers]
    same = (sizes[like] == sizes).all()
    if same:
        every = np.arange(starts.size)
        same = np.array_equal(gather(points, starts, sizes, like)[0], gather(points, starts, sizes, every)[0])
    if not same:  # different words share a hash: number them by themselves
        known: dict[bytes, int] = {}
        numbers = np.array([known.setdefault(points[a:b].tobytes(), len(known)) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)])
    return numbers, lengths


def ngram_sets(texts: list[str]) -> list[np.ndarray]:
    """The set of n-grams of each text as sorted numbers, equal for equal n-grams of words and no others."""
    numbers, lengths = numbered_words(texts)
    if not numbers.size:
        return [np.empty(0, np.int64)] * len(texts)
    words = int(numbers.max()) + 2
    numbers, lengths = _filled(numbers, lengths, words - 1)
    grams = numbers
    for k in range(1, WORDS):
        # Of the run so far and the next word one number is made; both are below 2^31, so that no two runs share it.
        grams = np.unique(grams[:-1] * words + numbers[k:], return_inverse=True)[1].reshape(-1)
    begins, counts = _starts_of_ngrams(lengths)
    grams = grams[np.flatnonzero(begins)]
    total = int(grams.max()) + 1
    text = np.repeat(np.arange(counts.size), counts)
    found = np.unique(text * total + grams)
    return np.split(found % total, np.searchsorted(found // total, np.arange(1, counts.size)))


def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    n = BANDS * ROWS
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def signatures(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """MinHash values (a row for each text that has n-grams, in order), of which the low 16 bits are kept."""
    counts = counts[counts > 0]
    out = np.empty((counts.size, BANDS * ROWS), np.uint16)
    if counts.size:
        starts = np.cumsum(counts) - counts
        low = (hashes >> np.uint64(32)).astype(np.uint32)
        for i, (a, b) in enumerate(zip(*_factors(), strict=True)):
            out[:, i] = np.minimum.reduceat(low * a + b, starts).astype(np.uint16)
    return out


def band_keys(bands: range) -> Column:
    """The keys of a signature's bands."""
    width = ROWS * 2
    return F.transform(F.sequence(F.lit(bands.start), F.lit(bands.stop - 1)), lambda b: F.xxhash64(F.substring(F.col("sig"), b * width + 1, F.lit(width)), b))


def least_matches(n: int, tolerance: float = TOLERANCE) -> int:
    """The least number of equal MinHash values among ``n`` at which a pair may still reach the threshold.

    Under a uniform prior the similarity is Beta distributed; the chance that it is at least t after m of n matches is
    that of at most m successes in n + 1 draws with probability t.
    """
    t, total = THRESHOLD[0] / THRESHOLD[1], 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


_LEAST = [least_matches(n) for n in range(STEP, BANDS * ROWS + 1, STEP)]


# ---------------------------------------------------------------- pairs


def pruned(signature: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that no number of compared MinHash values rules out."""
    out = []
    for part in range(0, x.size, PAIRS):
        a, b = x[part : part + PAIRS], y[part : part + PAIRS]
        met = np.zeros(a.size, np.int64)
        for least, at in zip(_LEAST, range(0, BANDS * ROWS, STEP), strict=True):
            met += (signature[a, at : at + STEP] == signature[b, at : at + STEP]).sum(axis=1)
            stay = met >= least
            a, b, met = a[stay], b[stay], met[stay]
            if not a.size:
                break
        out.append((a, b))
    none = np.empty(0, np.int64)
    return (np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])) if out else (none, none)


def reached(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least label that each row reaches over the pairs."""
    label = label.copy()
    while x.size:
        before = label.copy()
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        if (before == label).all():
            break
    return label


def joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The labels after those of each pair are made one, the least: all rows of a label move together."""
    if not x.size:
        return label
    names, code = np.unique(label, return_inverse=True)
    return names[reached(np.arange(names.size), code[x], code[y])[code]]


def linked_labels(signature: np.ndarray, label: np.ndarray, split: int | None) -> np.ndarray:
    """Labels of rows after pairs that are not ruled out are joined; pairs with one label need no comparison.

    ``split``: rows before it are compared with rows from it on, else all with each other. A few rows are compared with
    all others first, which joins most of a dense bucket.
    """
    n = label.size
    every = np.arange(n)
    for leader in dict.fromkeys((0, n - 1, n // 2)):
        other = every[label != label[leader]]
        label = joined(label, *pruned(signature, np.full(other.size, leader), other))
    last = n if split is None else split
    step = max(1, (1 << 20) // n)
    for at in range(0, last, step):
        rows, columns = every[at : min(at + step, last)], every if split is None else every[split:]
        open_ = label[rows][:, None] != label[columns]
        if split is None:
            open_ &= rows[:, None] < columns
        x, y = np.nonzero(open_)
        label = joined(label, *pruned(signature, rows[x], columns[y]))
    return label


class Side:
    """Representatives of a block: ids, class sizes, sets of n-grams and MinHash values."""

    def __init__(self, ids: list[int], sizes: list[int], sets: list[np.ndarray], signature: np.ndarray):
        self.ids, self.sizes = np.array(ids, np.int64), np.array(sizes, np.int64)
        self.sets, self.signature = sets, signature
        self.lengths = np.array([s.size for s in sets], np.int64)


def alike(a: Side, b: Side | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs at or above the threshold, within a block or between two."""
    other = b or a
    low, high = np.minimum(a.lengths[:, None], other.lengths), np.maximum(a.lengths[:, None], other.lengths)
    open_ = THRESHOLD[1] * low >= THRESHOLD[0] * high
    x, y = np.nonzero(np.triu(open_, 1) if b is None else open_)
    both = a.signature if b is None else np.concatenate([a.signature, b.signature])
    shift = 0 if b is None else a.ids.size
    x, y = pruned(both, x, y + shift)
    y = y - shift
    if not x.size:
        return x, y
    if x.size > 4 * (a.ids.size + other.ids.size):
        shared = _overlaps(a, other)[x, y]
    else:
        shared = np.array([_common(a.sets[i], other.sets[j]) for i, j in zip(x.tolist(), y.tolist(), strict=True)], np.int64)
    union = a.lengths[x] + other.lengths[y] - shared
    near = THRESHOLD[1] * shared >= THRESHOLD[0] * union
    return x[near], y[near]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    at = np.searchsorted(b, a)
    at[at == b.size] = 0
    return int(np.count_nonzero(b[at] == a))


def _overlaps(a: Side, b: Side, width: int = 8192) -> np.ndarray:
    """Sizes of all intersections, by products of slices of the incidence matrices."""
    out = np.zeros((a.ids.size, b.ids.size), np.float64)
    ours, theirs = np.concatenate(a.sets), np.concatenate(b.sets)
    all_, seen = np.unique(np.concatenate([ours, theirs]), return_counts=True)
    all_ = all_[seen > 1]
    if not all_.size:
        return out.astype(np.int64)

    def entries(side: Side, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        column = np.searchsorted(all_, flat)
        column[column == all_.size] = 0
        real = all_[column] == flat
        return np.repeat(np.arange(side.ids.size), side.lengths)[real], column[real]

    (ra, ca), (rb, cb) = entries(a, ours), entries(b, theirs)
    for at in range(0, all_.size, width):
        pair = []
        for rows, columns, n in ((ra, ca, a.ids.size), (rb, cb, b.ids.size)):
            own = (columns >= at) & (columns < at + width)
            m = np.zeros((n, min(width, all_.size - at)), np.float32)
            m[rows[own], columns[own] - at] = 1
            pair.append(m)
        out += pair[0] @ pair[1].T
    return np.rint(out).astype(np.int64)


def link_rows(a: Side, b: Side | None) -> pa.RecordBatch:
    """For every representative with a link in the tile: its linked rows and the least id it reaches in the tile."""
    x, y = alike(a, b)
    ids = a.ids if b is None else np.concatenate([a.ids, b.ids])
    sizes = a.sizes if b is None else np.concatenate([a.sizes, b.sizes])
    y = y if b is None else y + a.ids.size
    links = np.bincount(x, sizes[y], ids.size).astype(np.int64) + np.bincount(y, sizes[x], ids.size).astype(np.int64)
    root = reached(ids, x, y)
    met = links > 0
    return pa.RecordBatch.from_arrays([pa.array(ids[met]), pa.array(links[met]), pa.array(root[met])], names=["vid", "links", "root"])


# ---------------------------------------------------------------- the operator


def _signed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        for batch, texts in text_batches(batches, "text", BATCH_CHARS):
            hashes, counts = shingles(texts)
            rows = iter(signatures(hashes, counts))
            sigs = [next(rows).tobytes() if c else None for c in counts.tolist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sigs, pa.binary())], names=["doc_id", "ck", "_file", "_line", "bytes", "sig"])

    wide = docs.select("doc_id", "ck", "_file", "_line", F.octet_length("text").cast("long").alias("bytes"), "text")
    return wide.mapInArrow(run, "doc_id long, ck string, _file long, _line long, bytes long, sig binary")


def _grouped(batches: Iterator[pa.RecordBatch], tile: list[str], value: str) -> Iterator[dict[str, list]]:
    """The rows of each tile (``tile``: its columns), a repeated ``value`` of one block left out, as lists by column."""
    held: list[tuple] = []
    names: list[str] = []

    def made() -> dict[str, list]:
        return dict(zip(names, map(list, zip(*held, strict=True)), strict=True))

    for batch in batches:
        names = batch.schema.names
        head, at = [names.index(c) for c in tile], [names.index("own"), names.index(value)]
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and any(row[k] != held[0][k] for k in head):
                yield made()
                held = []
            if not held or any(row[k] != held[-1][k] for k in at):
                held.append(row)
    if held:
        yield made()


def _signature_rows(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint16).reshape(-1, BANDS * ROWS)


def _dealt(rows: DataFrame, tile: str, size: Column) -> DataFrame:
    """Rows (``vid`` and others) sent to the tiles of their block: pairs of blocks of the rows of one ``tile``."""
    rows = rows.withColumn("_blocks", size.cast("int")).withColumn("own", F.pmod(F.xxhash64("vid"), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.withColumn("i", F.least("own", "_other")).withColumn("j", F.greatest("own", "_other")).drop("_blocks", "_other")
    return rows.repartition(shuffle_width(rows.sparkSession), tile, "i", "j").sortWithinPartitions(tile, "i", "j", "own", "vid")


def candidate_links(classes: DataFrame, bands: range) -> DataFrame:
    """``u, v`` (u > v): links that join all pairs of ``classes`` (``vid, label, sig``) which share a band and are not
    ruled out; pairs with one ``label`` are joined already.

    Only buckets with more than one label are compared; of buckets with the same members one is.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for held in _grouped(batches, ["key", "i", "j"], "vid"):
            own = np.array(held["own"])
            split = None if held["i"][0] == held["j"][0] else int(np.count_nonzero(own == held["i"][0]))
            if own.size < 2 or split in (0, own.size):
                continue
            before, vids = np.array(held["label"], np.int64), np.array(held["vid"], np.int64)
            label = linked_labels(_signature_rows(held["sig"]), before, split)
            moved = label != before
            edges = np.unique(np.stack([before[moved], label[moved]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0].copy()), pa.array(edges[:, 1].copy())], names=["u", "v"])

    keyed = classes.select("vid", "label", F.explode(band_keys(bands)).alias("key"))
    sums = F.sum(F.xxhash64("vid").cast("decimal(20,0)")).cast("string").alias("sum")
    buckets = keyed.groupBy("key").agg(F.count("*").alias("members"), F.min("label").alias("a"), F.max("label").alias("b"), F.min("vid").alias("first"), F.max("vid").alias("last"), sums)
    buckets = buckets.where("members > 1 and a < b").groupBy("members", "first", "last", "sum").agg(F.min("key").alias("key"))
    buckets = staged(buckets.select("key", "members"), "buckets")
    if buckets.isEmpty():
        return classes.sparkSession.createDataFrame([], "u long, v long")
    met = staged(lookup(keyed, buckets, "key", "members").where("members is not null"), "met")
    total = met.groupBy("vid").agg(F.count("*").alias("w"))
    sigs = staged(classes.select("vid", "sig").join(sized_broadcast(staged(total, "weights")), "vid"), "signatures")
    rows = lookup(met, sigs, "vid", "w").select("key", "members", "vid", "label", "sig")
    dealt = _dealt(rows, "key", F.ceil(F.col("members") / BLOCK))
    return staged(dealt.select("key", "i", "j", "own", "vid", "label", "sig").mapInArrow(run, "u long, v long"), "candidates")


_FOUND = pa.schema([("vid", pa.int64()), ("links", pa.int64()), ("root", pa.int64()), ("grp", pa.int64()), ("own", pa.int32()), ("blocks", pa.int32()), ("path", pa.string()), ("start", pa.int64()), ("length", pa.int64())])
FOUND = "vid long, links long, root long, grp long, own int, blocks int, path string, start long, length long"


class Block:
    """Representatives of a group that are compared together: ids, class sizes, signatures and texts."""

    def __init__(self, vid: list[int], n: list[int], sig: list[bytes], text: list[str]):
        self.vid, self.n, self.sig, self.text = vid, n, sig, text

    def packed(self) -> bytes:
        data = [t.encode() for t in self.text]
        ends = np.cumsum([len(d) for d in data])
        return pack(vid=np.array(self.vid, np.int64), n=np.array(self.n, np.int64), sig=_signature_rows(self.sig).ravel(), ends=ends, text=np.frombuffer(b"".join(data), np.uint8))

    @staticmethod
    def unpacked(data: bytes) -> Block:
        a = unpack(data)
        text, ends = a["text"].tobytes(), a["ends"].tolist()
        return Block(a["vid"].tolist(), a["n"].tolist(), [r.tobytes() for r in a["sig"].reshape(-1, BANDS * ROWS)], [text[i:j].decode() for i, j in zip([0, *ends], ends, strict=False)])

    @staticmethod
    def compared(one: Block, other: Block | None = None) -> pa.RecordBatch:
        """Links within a block, or between two."""
        parts = [one] if other is None else [one, other]
        sets, sides, at = ngram_sets([t for p in parts for t in p.text]), [], 0
        for p in parts:
            sides.append(Side(p.vid, p.n, sets[at : at + len(p.vid)], _signature_rows(p.sig)))
            at += len(p.vid)
        return link_rows(sides[0], sides[1] if other is not None else None)


def _within_blocks(rows: DataFrame, folder: str) -> DataFrame:
    """Rows (``root, own, vid, blocks, n, sig, text``) compared within their block: links, and a row for every block that
    has others beside it, which stands in the task's file from then on. So every text is dealt once."""

    def run(batches: Iterator[pa.RecordBatch]):
        path = f"{folder}/blocks-{TaskContext.get().partitionId():06d}"
        file, index = Writer(path), []
        for held in _grouped(batches, ["root", "own"], "vid"):
            block = Block(held["vid"], held["n"], held["sig"], held["text"])
            out = Block.compared(block)
            if out.num_rows:
                yield _as_found(out)
            if held["blocks"][0] > 1:
                data = block.packed()
                index.append({"grp": held["root"][0], "own": held["own"][0], "blocks": held["blocks"][0], "path": path, "start": file.write(data), "length": len(data)})
        file.close()
        if index:
            yield pa.RecordBatch.from_pylist(index, schema=_FOUND)

    return rows.select("root", "own", "vid", "blocks", "n", "sig", "text").mapInArrow(run, FOUND)


def _as_found(out: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([out.column(c) if c in out.schema.names else pa.nulls(out.num_rows, _FOUND.field(c).type) for c in _FOUND.names], schema=_FOUND)


def _between_blocks(index: DataFrame) -> DataFrame:
    """Links between every two blocks of a group, which tasks read from the files of ``index``."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for r in batch.to_pylist():
                one, other = (Block.unpacked(read_range(r[f"path{k}"], r[f"start{k}"], r[f"length{k}"])) for k in (1, 2))
                out = Block.compared(one, other)
                if out.num_rows:
                    yield out

    place = lambda k: [F.col(c).alias(f"{c}{k}") for c in ("path", "start", "length")]
    one = index.where("own < blocks - 1").select("grp", "own", *place(1), F.explode(F.sequence(F.col("own") + 1, F.col("blocks") - 1)).alias("other"))
    two = index.select("grp", F.col("own").alias("other"), *place(2))
    tiles = one.join(two, ["grp", "other"])
    return tiles.repartition(shuffle_width(index.sparkSession), "grp", "own", "other").mapInArrow(run, "vid long, links long, root long")


def _labelled(classes: DataFrame, groups: DataFrame) -> DataFrame:
    named = groups.select(F.col("u").alias("vid"), "v")
    return classes.join(sized_broadcast(named), "vid", "left").withColumn("label", F.coalesce("v", "vid")).drop("v")


def join(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ck, copies, class_id, class_key, n_links`` for every row of ``docs``.

    Two documents are linked when their sets of five-word n-grams have a Jaccard similarity of at least 0.8; equal
    texts (``ck``: MD5) always are, also those without words. ``n_links`` counts the other rows a document is linked
    to, copies included; ``class_id`` is the least key of all that are linked to it directly or through others. A null
    text is empty. Rows that repeat a key with one text are copies; where all keys of a class are null, it goes by a
    negative hash of a text, which may be another class's key. One key with different texts may be the least of several
    classes: ``class_key``, the least ``ck`` of a class, tells classes apart in all cases.

    Equal texts become one representative with a number of its own. Representatives that share a band of MinHash values
    are compared value by value, in tiles of two blocks of a bucket's signatures, and dropped once the posterior
    probability of reaching the threshold is below ``TOLERANCE``; in two rounds, of which the second only compares what
    the first has not joined. What is joined forms groups, whose texts, in blocks bounded by rows and bytes, are compared
    in the same way and verified by their words; a group of several blocks is kept in files, which a task reads two at a
    time, so that a text is dealt once however large its group. A tile returns sums and a spanning forest, never
    pairs.
    """
    base = located(docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))).withColumn("ck", F.md5("text"))
    signed = staged(_signed(base), "signed")
    place = F.min(F.struct("_file", "_line"))
    classes = signed.groupBy("ck").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), place.alias("at"), F.first("bytes").alias("bytes"), F.first("sig").alias("sig"))
    classes = staged(classes.select("ck", F.monotonically_increasing_id().alias("vid"), "least", "n", "at", "bytes", "sig"), "classes")

    worded = classes.where("sig is not null").select("vid", "sig")
    groups = components(candidate_links(worded.withColumn("label", F.col("vid")), range(FIRST_BANDS)))
    later = candidate_links(_labelled(worded, groups), range(FIRST_BANDS, BANDS))
    groups = groups if later.isEmpty() else components(groups.unionByName(later))

    roots = groups.select(F.col("u").alias("vid"), F.col("v").alias("root")).unionByName(groups.select(F.col("v").alias("vid"), F.col("v").alias("root")).distinct())
    found = classes.select("vid", "ck", "at", "n", "bytes", "sig").join(sized_broadcast(staged(roots, "roots")), "vid")
    found = staged(found, "grouped")
    sizes = staged(found.groupBy("root").agg(F.count("*").alias("members"), F.sum("bytes").alias("size")), "sizes")
    placed = staged(lookup(found, sizes, "root", "members").select("vid", "ck", F.col("at._file").alias("_file"), F.col("at._line").alias("_line"), "n", "root", "members", "size", "sig", F.lit(1).alias("one")), "placed")
    texts = base.join(sized_broadcast(placed.select("_file", "_line", "ck", "vid")), ["_file", "_line", "ck"]).select("vid", "text")
    rows = lookup(texts, placed.select("vid", "n", "root", "members", "size", "sig", "one"), "vid", "one").drop("one")
    # As many blocks as rows and bytes ask for, but never more than members: a text that is longer than a block is one.
    blocks = F.least(F.col("members"), F.greatest(F.ceil(F.col("members") / TEXT_BLOCK), F.ceil(F.col("size") / TEXT_BYTES))).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int"))
    rows = rows.repartition(shuffle_width(rows.sparkSession), "root", "own").sortWithinPartitions("root", "own", "vid")
    first = staged(_within_blocks(rows, scratch(docs.sparkSession, "blocks")), "within")
    index = first.where("path is not null").select("grp", "own", "blocks", "path", "start", "length")
    tiles = first.where("vid is not null").select("vid", "links", "root")
    if not index.isEmpty():
        tiles = tiles.unionByName(staged(_between_blocks(index), "between"))

    links = tiles.groupBy("vid").agg(F.sum("links").alias("links"))
    forest = components(tiles.select(F.col("vid").alias("u"), F.col("root").alias("v")).where("u <> v"))
    info = classes.select("vid", "ck", "least", "n").join(links, "vid", "left").join(forest.withColumnRenamed("u", "vid"), "vid", "left")
    info = staged(info.select("ck", "least", "n", F.coalesce("v", "vid").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "info")
    named = info.groupBy("root").agg(F.min("least").alias("class_least"), F.min("ck").alias("class_key"), F.count("*").alias("reps"))
    named = staged(named.where("reps > 1"), "named")
    info = lookup(info, named, "root", "reps").withColumn("class_key", F.coalesce("class_key", "ck"))
    class_id = F.coalesce("class_least", "least", -F.abs(F.xxhash64("class_key")) - 1)
    info = staged(info.select("ck", "n", class_id.alias("class_id"), "class_key", "n_links"), "named-info")
    members = lookup(signed.select("doc_id", "ck"), info, "ck", "n")
    return members.select("doc_id", "ck", F.col("n").alias("copies"), "class_id", "class_key", "n_links")

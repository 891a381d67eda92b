"""Spelling variants: words one edit apart, found by merging the light subtrees of an errata trie.

Two words are near if they differ by one inserted, deleted or replaced code point. Every pair belongs to one node of the
trie of all words, that of their common prefix; past it one character is replaced or skipped and the rest coincides.
Nodes over many words are worked out by a shuffle on the rest; subtrees of at most ``SUBTREE_WORDS`` words and
``SUBTREE_CHARS`` characters are tries within a task, where at each node the light subtrees are walked beside the heavy
one. A walk costs what the light subtrees hold, so that a word is walked a logarithmic number of times.

Odd inputs: a null text holds no runs; a null key counts as an empty string before the colon; repeated rows count each
time; other columns are not read; an empty table gives no rows. Words of any length are compared in whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix
from string import ascii_lowercase, ascii_uppercase

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import lookup, staged

RUN = "[A-Za-zÀ-ÿ]"
LEAST_CHARS, LEAST_COUNT, RATIO = 6, 5, 5
SLIPS = 199  # one in so many occurrences loses a code point
SUBTREE_WORDS, SUBTREE_CHARS = 2048, 1 << 16  # of a trie within a task

LINKS = pa.schema([("a", pa.string()), ("an", pa.int64()), ("b", pa.string()), ("bn", pa.int64())])


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: runs of letters, A to Z in lower case, one in ``SLIPS`` without one of its code points."""
    # A run that is too short cannot become long enough.
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), F.explode(F.regexp_extract_all(text, F.lit(f"{RUN}{{{least_chars},}}"), 0)).alias("_run"))
    runs = runs.select("_key", F.translate("_run", ascii_uppercase, ascii_lowercase).alias("_run"))
    runs = runs.select("_run", F.crc32(F.concat("_key", F.lit(":"), "_run").cast("binary")).alias("_h"))
    at = (F.col("_h") % F.char_length("_run")).cast("int")
    slipped = F.concat(F.substring(F.col("_run"), F.lit(1), at), F.substring(F.col("_run"), at + 2, F.char_length("_run")))
    words = runs.select(F.when(F.col("_h") % SLIPS == 0, slipped).otherwise(F.col("_run")).alias("word")).where(F.char_length("word") >= least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _trie(words: list[str], start: int) -> tuple[list[dict], list[int], list[int]]:
    """Children, number of the word that ends (or -1) and number of words, for every node; node 0 holds all words, whose
    first ``start`` characters are left out."""
    kids: list[dict] = [{}]
    ends, sizes = [-1], [0]
    for i, word in enumerate(words):
        at = 0
        sizes[0] += 1
        for c in word[start:]:
            below = kids[at].get(c)
            if below is None:
                below = kids[at][c] = len(kids)
                kids.append({})
                ends.append(-1)
                sizes.append(0)
            at = below
            sizes[at] += 1
        ends[at] = i
    return kids, ends, sizes


def near_pairs(words: list[str], start: int = 0) -> Iterator[tuple[int, int]]:
    """Numbers of every two words that are one edit apart, once each; ``words`` are distinct and alike up to ``start``."""
    kids, ends, sizes = _trie(words, start)
    for node, below in enumerate(kids):
        if not below:
            continue
        heavy_char = max(below, key=lambda c: sizes[below[c]])
        heavy = below[heavy_char]
        if ends[node] >= 0 and ends[heavy] >= 0:
            yield ends[node], ends[heavy]
        if len(below) == 1:
            continue
        light = [(c, k) for c, k in below.items() if k != heavy]
        # The light subtrees without their first character, walked beside the heavy one without its own (replaced), and
        # beside the node itself (skipped). Of a run of one character the last one is skipped, so that no pair comes twice.
        walk = [(light, heavy, node, "")]
        while walk:
            merged, replaced, whole, first = walk.pop()
            met = [(c, ends[k]) for c, k in merged if ends[k] >= 0]
            for i, (_, word) in enumerate(met):
                for _, other in met[:i]:
                    yield other, word
            if replaced >= 0 and ends[replaced] >= 0:
                for _, word in met:
                    yield ends[replaced], word
            if whole >= 0 and ends[whole] >= 0:
                for c, word in met:
                    if c != first:
                        yield ends[whole], word
            deeper: dict[str, list] = {}
            for c, k in merged:
                for x, child in kids[k].items():
                    deeper.setdefault(x, []).append((c, child))
            for x, rest in deeper.items():
                walk.append((rest, kids[replaced].get(x, -1) if replaced >= 0 else -1, kids[whole].get(x, -1) if whole >= 0 else -1, first or x))
        # The heavy subtree without its first character, beside what the light ones hold.
        walk = [(k, kids[heavy][c]) for c, k in light if c in kids[heavy]]
        while walk:
            one, other = walk.pop()
            if ends[one] >= 0 and ends[other] >= 0:
                yield ends[one], ends[other]
            walk.extend((k, kids[other][x]) for x, k in kids[one].items() if x in kids[other])


def _subtree_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each prefix ``u``; rows (``u, word, n``) come sorted by it."""
    prefix, words, counts = None, [], []

    def done():
        if len(words) > 1:
            rows = [(words[i], counts[i], words[j], counts[j]) for i, j in near_pairs(words, len(prefix))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), LINKS.types, strict=True)], schema=LINKS)

    for batch in batches:
        for u, word, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if u != prefix:
                yield from done()
                prefix, words, counts = u, [], []
            words.append(word)
            counts.append(n)
    yield from done()


@F.pandas_udf(T.IntegerType())
def _common(low: pd.Series, high: pd.Series) -> pd.Series:
    return pd.Series([len(commonprefix([a, b])) for a, b in zip(low, high, strict=True)], dtype="int32")


def _node_links(rows: DataFrame) -> DataFrame:
    """Links at the nodes that ``rows`` (``word, n, depth``) pass: those whose words coincide once the character at
    ``depth`` is replaced or skipped. What coincides differs in that character alone, so no group is larger than the
    alphabet."""
    depth, length = F.col("depth"), F.char_length("word")
    behind = F.substring(F.col("word"), depth + 2, length)
    skipped = F.struct(F.concat(F.substring(F.col("word"), F.lit(1), depth), behind).alias("rest"), F.substring(F.col("word"), depth + 1, F.lit(1)).alias("c"))
    itself = F.struct(F.col("word").alias("rest"), F.lit(None).cast("string").alias("c"))
    forms = rows.select("word", "n", "depth", F.explode(F.when(length > depth, F.array(itself, skipped)).otherwise(F.array(itself))).alias("_f"))
    met = forms.groupBy("depth", "_f.rest").agg(F.sort_array(F.collect_list(F.struct("_f.c", "word", "n"))).alias("_met")).where(F.size("_met") > 1)
    one = met.select("depth", "rest", "_met", F.posexplode("_met").alias("_i", "_a"))
    two = one.select("depth", "rest", "_a", F.explode(F.slice("_met", F.lit(1), F.col("_i"))).alias("_b"))
    # A null character marks the word itself; it is met by words that skip the last of a run only.
    last = F.substring(F.col("rest"), F.col("depth") + 1, F.lit(1)) != F.col("_a.c")
    return two.where(F.col("_b.c").isNotNull() | last).select(F.col("_a.word").alias("a"), F.col("_a.n").alias("an"), F.col("_b.word").alias("b"), F.col("_b.n").alias("bn"))


def links(words: DataFrame, most_words: int = SUBTREE_WORDS, most_chars: int = SUBTREE_CHARS) -> DataFrame:
    """``a, an, b, bn``: every two of the distinct ``words`` (``word, n``) that are one edit apart, once each.

    Prefixes shared by too many words are opened round by round, each at the place where its words part; the words below
    go on with one character more.
    """
    spark = words.sparkSession
    rows = staged(words.select(F.lit("").alias("u"), "word", "n"), "words")
    small, nodes = [], []
    while True:
        groups = rows.groupBy("u").agg(F.count("*").alias("w"), F.sum(F.char_length("word")).alias("_chars"), F.min("word").alias("_low"), F.max("word").alias("_high"))
        large = groups.where((F.col("w") > most_words) | ((F.col("_chars") > most_chars) & (F.col("w") > 1)))
        large = staged(large.select("u", "w", _common("_low", "_high").alias("depth")), "large")
        if large.isEmpty():
            small.append(rows)
            break
        marked = staged(lookup(rows, large, "u", "w").select("u", "word", "n", "depth"), "marked")
        small.append(marked.where("depth is null").drop("depth"))
        nodes.append(marked.where("depth is not null").select("word", "n", "depth"))
        below = nodes[-1].where(F.char_length("word") > F.col("depth"))
        rows = staged(below.select(F.substring(F.col("word"), F.lit(1), F.col("depth") + 1).alias("u"), "word", "n"), "words")
    subtrees = small[0]
    for part in small[1:]:
        subtrees = subtrees.unionByName(part)
    found = subtrees.repartition("u").sortWithinPartitions("u", "word").mapInArrow(_subtree_links, "a string, an long, b string, bn long")
    if nodes:
        passed = nodes[0]
        for part in nodes[1:]:
            passed = passed.unionByName(part)
        found = found.unionByName(_node_links(passed))
    return found


def forms(words: DataFrame, found: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: each word's near words, the most frequent of them where it is ``ratio``
    times as frequent as the word (of ties the first in code-point order), and the end of the chain of such forms."""
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("bn").alias("an"), F.col("a").alias("b"), F.col("an").alias("bn")))
    best = both.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("bn")).alias("less"), F.col("b"))).alias("_best"))
    best = best.select(F.col("a").alias("word"), "n_near", F.col("_best.b").alias("form"), (-F.col("_best.less")).alias("form_n"))
    enough = F.col("form_n") >= ratio * F.col("n")
    known = staged(
        words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *(F.when(enough, F.col(c)).alias(c) for c in ("form", "form_n"))),
        "forms",
    )
    # A form is at least ``ratio`` times as frequent, so chains are short; each round doubles the steps taken.
    roots = known.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = staged(roots.join(further, "root", "left"), "roots")
        roots = moved.select("word", F.coalesce("_next", "root").alias("root"))
        if moved.where("_next is not null").isEmpty():
            break
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of all words of ``docs``."""
    words = staged(word_counts(docs, key, text), "counts")
    return forms(words, links(words))

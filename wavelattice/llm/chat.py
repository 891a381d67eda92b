"""Conversations as training examples: one for each assistant turn, with all turns before it as context.

An example is a prefix of its conversation, and only the reply at its end is trainable: every assistant turn is a target of
its own, and all turns before it are written out again as its prefix. So the examples of a conversation grow with the square
of its turns, which is the method's cost.

Rows are dealt by ranges of (conversation, turn, role, text), so that a conversation with a third of all turns is formatted
by many tasks. A conversation that one task holds, and whose examples take at most ``CHUNK`` characters, is written as one
row with all of its examples. The turns of others are written in chunks of at most ``CHUNK`` characters (a longer turn is a
chunk of its own), and what the tasks before have written of a conversation is added to offsets by a table of a row a task;
then ``expanded`` joins each reply to the chunks up to it and writes its example in as many pieces. No row is larger than a
chunk, and ``BLOCK`` examples of a conversation at a time are written by a task.

Odd inputs: a null text, role or both are empty; null turns come first, ties of a turn go by role and text, and repeated
rows are turns of their own; rows with a null conversation are one conversation; other columns are not read; an empty table
gives no rows. Turns after the last reply are stored behind the examples and in none of them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import shuffle_width, sized_broadcast, staged, text_or_empty

# Spark reads Parquet 4,096 rows at a time, so that rows have to be small.
CHUNK = 1 << 15
BLOCK = 64
BATCH = 1 << 20
REPLY = "assistant"

# The template: "### role: text</turn>\n". Control strings inside roles and texts lose their first character to an escape,
# so that they never stand there; so do colons inside roles.
_CONTROL = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_ROLE = re.compile(r"\\|#(?=##)|<(?=/turn>)|:")
_TO = {"\\": "\\\\", "#": "\\h", "<": "\\l", ":": "\\c"}
_ESCAPED = re.compile(r"\\(.)")
_FROM = {v[1]: k for k, v in _TO.items()}
_TURN = re.compile(r"### ([^:]*): (.*?)</turn>\n", re.DOTALL)

_SPAN = pa.struct([("turn", pa.int64()), ("start", pa.int64()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("end", pa.int64()), ("text", pa.string())])
_CHUNKS = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("chunk", pa.int64()), ("whole", pa.bool_()), ("start", pa.int64()), ("first_turn", pa.int64()), ("turns", pa.int64()), ("text", pa.string()), ("replies", pa.list_(_SPAN))])
CHUNKS = "conv_id long, part int, chunk long, whole boolean, start long, first_turn long, turns long, text string, replies array<struct<turn: long, start: long, loss_start: long, loss_end: long, end: long, text: string>>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: _TO[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _FROM[m[1]], text)


def piece(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text starts and ends there."""
    head, body = f"### {_ROLE.sub(lambda m: _TO[m[0]], role)}: ", escape(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def turns_of(text: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of formatted turns."""
    at = 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        yield unescape(m[1]), unescape(m[2])
        at = m.end()


def _write(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Conversations of one task, whose rows (conversation, role, text) come in order. One that the task holds neither first
    nor last, with examples of ``most`` characters in all, is ``whole``: each reply has its example's text, and ``text`` is
    what follows the last. Of all others, more may stand elsewhere: their ``text`` is a chunk, and replies have none yet."""
    part = TaskContext.get().partitionId()
    rows: list[dict] = []
    size = 0
    now = None  # the chunk being filled
    pieces: list[str] = []
    first = True  # whether the conversation is the task's first
    at = 0  # characters of the conversation so far
    spread = 0  # and of its examples

    def close(last: bool, more: bool):
        nonlocal size
        whole = not (first or last or more or now["chunk"]) and spread <= most
        text = "".join(pieces)
        size += len(text)
        if whole and now["replies"]:
            for r in now["replies"]:
                r["text"] = text[: r["end"]]
            text = text[now["replies"][-1]["end"] :]
            size += spread
        rows.append({**now, "whole": whole, "text": text})

    def flush():
        nonlocal rows, size
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_CHUNKS)
        rows, size = [], 0

    for batch in batches:
        for conv, role, text in zip(*(batch.column(k) for k in range(3)), strict=True):
            conv, (formatted, begin, end) = conv.as_py(), piece(role.as_py(), text.as_py())
            if now is not None and now["conv_id"] != conv:
                close(False, False)
                first, now = False, None
            elif now is not None and at - now["start"] + len(formatted) > most:
                close(False, True)
                now = {"conv_id": conv, "part": part, "chunk": now["chunk"] + 1, "start": at, "first_turn": now["first_turn"] + now["turns"], "turns": 0, "replies": []}
                pieces = []
            if now is None:
                at, spread, pieces = 0, 0, []
                now = {"conv_id": conv, "part": part, "chunk": 0, "start": 0, "first_turn": 0, "turns": 0, "replies": []}
            if role.as_py() == REPLY:
                now["replies"].append({"turn": now["first_turn"] + now["turns"], "start": at, "loss_start": at + begin, "loss_end": at + end, "end": at + len(formatted)})
                spread += at + len(formatted)
            now["turns"] += 1
            pieces.append(formatted)
            at += len(formatted)
            if size > BATCH:
                yield from flush()
    if now is not None:
        close(True, False)
    yield from flush()


def formatted(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Formatted conversations, written to the shared folder: the examples of most, the chunks of others, for ``expanded``;
    offsets count within a conversation and ``part``."""
    most = CHUNK
    cols = [F.col(conv).cast("long").alias("c"), F.col(turn).alias("t"), text_or_empty(role).alias("r"), text_or_empty(text).alias("x")]
    # Rows that tie in all of these are alike; the number only lets many of them go to several tasks.
    rows = turns.select(*cols, F.monotonically_increasing_id().alias("_n"))
    order = ["c", "t", "r", "x", "_n"]
    dealt = rows.repartitionByRange(shuffle_width(turns.sparkSession), *order).sortWithinPartitions(*order)
    return staged(dealt.select("c", "r", "x").mapInArrow(lambda batches: _write(batches, most), CHUNKS), "chat")


def _placed(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``_chars`` and ``_turns`` of their conversation in earlier parts, and ``_examples`` before the chunk."""
    some = chunks.where(~F.col("whole")).groupBy("conv_id", "part").agg(F.sum(F.char_length("text")).alias("n"), F.sum("turns").alias("m"), F.sum(F.size("replies")).alias("e"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = some.select("conv_id", F.col("part").alias("_part"), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(a) for c, a in (("n", "_chars"), ("m", "_turns"), ("e", "_parts_examples")))).withColumnRenamed("conv_id", "_conv")
    # Of these, a part holds its first and last conversation and those longer than a chunk; only its first goes on from another.
    carried = staged(sums.where("_turns > 0"), "carried")
    joined = chunks.join(F.broadcast(carried), (F.col("part") == F.col("_part")) & F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv", "_part")
    own = Window.partitionBy("conv_id", "part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    single = joined.where("whole").withColumn("_before", F.lit(0).cast("long"))
    rest = joined.where(~F.col("whole")).withColumn("_before", F.coalesce(F.sum(F.size("replies")).over(own), F.lit(0)).cast("long"))
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("_chars", "_turns")]
    return single.unionByName(rest).select(*chunks.columns, *zero, (F.col("_before") + F.coalesce("_parts_examples", F.lit(0))).cast("long").alias("_examples"))


def examples(chunks: DataFrame) -> DataFrame:
    """``conv_id, example, turn, context_chars, loss_start, loss_end, chars``: a row a reply, in characters of the example,
    which is the conversation's first ``chars``; only what lies between ``loss_start`` and ``loss_end`` is trainable."""
    rows = _placed(chunks).select("conv_id", "_chars", "_turns", "_examples", F.posexplode("replies").alias("_k", "_r"))
    moved = [(F.col("_chars") + F.col(f"_r.{c}")).alias(a) for c, a in (("start", "context_chars"), ("loss_start", "loss_start"), ("loss_end", "loss_end"), ("end", "chars"))]
    return rows.select("conv_id", (F.col("_examples") + F.col("_k")).alias("example"), (F.col("_turns") + F.col("_r.turn")).alias("turn"), *moved)


def _pieces_held(chunks: DataFrame) -> DataFrame:
    """Examples, and the turns behind the last, of the conversations that are ``whole``: those of each in order."""
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    end = F.coalesce(F.get("replies", F.size("replies") - 1)["end"], zero)

    def example(r, i):
        before = F.coalesce(F.get("replies", i - 1)["end"], zero)
        return F.struct(i.cast("long").alias("example"), r["turn"].alias("turn"), r["start"].alias("context_chars"), r["loss_start"].alias("loss_start"), r["loss_end"].alias("loss_end"), r["end"].alias("chars"), before.alias("fresh"), zero.alias("start"), r["text"].alias("text"))

    behind = F.struct(*(none.alias(c) for c in ("example", "turn", "context_chars", "loss_start", "loss_end", "chars")), end.alias("fresh"), end.alias("start"), F.col("text"))
    return chunks.where("whole").select("conv_id", F.inline(F.concat(F.transform("replies", example), F.filter(F.array(behind), lambda b: b["text"] != ""))))


def _pieces_joined(chunks: DataFrame) -> DataFrame:
    """The same of all others: each reply with the chunks of its conversation up to it."""
    chunks = chunks.where(~F.col("whole"))
    before = F.lag("chars", 1, 0).over(Window.partitionBy("conv_id").orderBy("example"))
    replies = staged(examples(chunks).withColumn("fresh", before).withColumn("_block", F.expr(f"example div {BLOCK}")), "replies")
    ends = replies.groupBy(F.col("conv_id").alias("_conv")).agg(F.max("example").alias("_last"), F.max("chars").alias("_end"))
    placed = _placed(chunks).select("conv_id", (F.col("_chars") + F.col("start")).alias("start"), F.char_length("text").cast("long").alias("_n"), F.col("_examples").alias("_first"), "text")
    own = placed.join(sized_broadcast(ends), F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")

    blocks = F.explode(F.sequence(F.expr(f"_first div {BLOCK}"), F.expr(f"_last div {BLOCK}"))).alias("_of")
    dealt = own.where("_first <= _last").select(F.col("conv_id").alias("_conv"), "start", "_n", "text", blocks).repartition(shuffle_width(chunks.sparkSession), "_conv", "_of")
    upto = dealt.join(sized_broadcast(replies), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_block") == F.col("_of")) & (F.col("start") < F.col("chars")))
    text = F.substring("text", F.lit(1), F.least(F.col("chars") - F.col("start"), "_n").cast("int")).alias("text")
    made = upto.select("conv_id", "example", "turn", "context_chars", "loss_start", "loss_end", "chars", "fresh", "start", text)

    end, none = F.coalesce("_end", F.lit(0).cast("long")), F.lit(None).cast("long")
    skipped = F.greatest(end - F.col("start"), F.lit(0))
    behind = own.where(end < F.col("start") + F.col("_n")).select(
        "conv_id", *(none.alias(c) for c in ("example", "turn", "context_chars", "loss_start", "loss_end", "chars")), end.alias("fresh"), (F.col("start") + skipped).alias("start"), F.substr("text", (skipped + 1).cast("int")).alias("text")
    )
    return made.unionByName(behind)


def _expanded(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pieces of conversations in order, and staged pieces of others in none."""
    return _pieces_held(chunks), staged(_pieces_joined(chunks), "examples")


def expanded(chunks: DataFrame) -> DataFrame:
    """All examples as they are stored: ``conv_id, example, turn, context_chars, loss_start, loss_end, chars, fresh, start,
    text``.

    An example of a row or more, of which each holds ``text`` from character ``start``: together the prefix and, between
    ``loss_start`` and ``loss_end``, the target. The first ``fresh`` characters are the example before. Turns behind the last
    reply have no example.
    """
    held, joined = _expanded(chunks)
    return held.unionByName(joined)


def example_texts(chunks: DataFrame) -> DataFrame:
    """``examples`` with ``text``, a row each."""
    cols = ["conv_id", "example", "turn", "context_chars", "loss_start", "loss_end", "chars"]
    rows = expanded(chunks).where(F.col("example").isNotNull())
    one = F.char_length("text") == F.col("chars")
    pieces = F.array_sort(F.collect_list(F.struct("start", "text")))
    several = rows.where(~one).groupBy(*cols).agg(F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"))
    return rows.where(one).select(*cols, "text").unionByName(several)


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_examples", pa.int64()), ("expanded_chars", pa.int64())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose examples come in order, without what the example before had."""
    now, turns, loss, none = None, None, None, object()
    conv = none
    out: list[dict] = []

    def close():
        out.append({**now, "conv_id": conv, "turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()})

    for batch in batches:
        for at, chars, text, begin, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != conv or conv is none:
                if conv is not none:
                    close()
                conv, turns, loss = at, hashlib.sha256(), hashlib.sha256()
                now = {"n_turns": 0, "loss_chars": 0, "formatted_chars": 0, "n_examples": 0, "expanded_chars": 0}
            for role, said in turns_of(text):
                turns.update(f"{role}\n{said}\n".encode())
                now["n_turns"] += 1
            if begin is not None:
                said = unescape(text[begin:end])
                loss.update(said.encode())
                now["loss_chars"] += len(said)
                now["n_examples"] += 1
            now["expanded_chars"] += chars
            now["formatted_chars"] += len(text)
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, schema=_DIGESTS)
            out.clear()
    if conv is not none:
        close()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_DIGESTS)


def digests(chunks: DataFrame) -> DataFrame:
    """Turns, loss and lengths of every conversation, read back from its stored examples.

    A turn is read from the first example that has it, a target from its own example. The examples of one row are read where
    they lie; those of other conversations are brought together in order, cut to what the one before had not, and pass
    through one task a conversation, piece by piece, as its digest is one chain.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, expanded_chars long"
    n = F.char_length("text").cast("long")
    known = F.least(F.greatest(F.col("fresh") - F.col("start"), F.lit(0)), n)
    targeted = F.col("loss_start") < F.col("start") + n
    chars = F.when(F.col("example").isNull(), 0).otherwise(n).alias("chars")
    text = F.substr("text", (known + 1).cast("int")).alias("text")
    read = ["conv_id", chars, text, *(F.when(targeted, F.col(c) - F.col("start") - known).alias(a) for c, a in (("loss_start", "begin"), ("loss_end", "end")))]
    held, joined = _expanded(chunks)
    rest = joined.select("example", F.col("start").alias("_at"), *read).repartition("conv_id").sortWithinPartitions("conv_id", F.col("example").asc_nulls_last(), "_at").drop("example", "_at")
    return held.select(*read).mapInArrow(_digest, schema).unionByName(rest.mapInArrow(_digest, schema))

"""Conversations as prefix examples, against plain Python."""

from __future__ import annotations

import hashlib
import time
from pathlib import Path

import pytest
from hypothesis import given
from hypothesis import strategies as st

from wavelattice.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, text_ string, part int"
HARD = r"\### Assistant: </turn> ok"


def plain(rows):
    """Turns of each conversation in order."""
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, (r or "").encode(), (x or "").encode()))
    return {c: [(r.decode(), x.decode()) for *_, r, x in sorted(v)] for c, v in convs.items()}


def rows_of(n=40):
    out = [(c, t, "assistant" if t % 2 else "user", f"c{c} t{t} " + "añ\U0001f600" * (c % 5)) for c in range(n) for t in range(c % 7)]
    out += [(1000, t, "assistant" if t % 3 == 2 else "user", f"{t} " + HARD * (t % 4)) for t in range(200)]
    out += [(None, 0, "user", "a"), (None, None, None, None), (2000, 0, "user", "same"), (2000, 0, "user", "same"), (2000, 0, "assistant", "same")]
    out += [(2001, 0, "a:b### </turn>\\", ""), (2001, 1, "assistant", "#####\n</turn>\n### assistant: x</turn>\n"), (2002, 0, "system", "only")]
    return out


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame([(*r, "other", 7) for r in rows_of()], SCHEMA).repartition(7)


@given(st.text("#</turn>\\hlc:\n aé", max_size=60), st.text("#:</turn>\\hc\n", max_size=20))
def test_turns_read_back(text, role):
    formatted, start, end = chat.piece(role, text)
    assert list(chat.turns_of(formatted + formatted)) == [(role, text)] * 2
    assert chat.unescape(formatted[start:end]) == text
    assert formatted.count("</turn>") == 1 and "###" not in formatted[3:]


@pytest.mark.parametrize("chunk", [1 << 20, 300])
def test_digests_and_examples(spark, turns, monkeypatch, chunk):
    monkeypatch.setattr(chat, "CHUNK", chunk)
    chunks = chat.formatted(turns)
    convs = plain(rows_of())
    found = {r.conv_id: r for r in chat.digests(chunks).collect()}
    assert found.keys() == convs.keys()
    texts = {(r.conv_id, r.example): r for r in chat.example_texts(chunks).collect()}
    listed = {(r.conv_id, r.example): r for r in chat.examples(chunks).collect()}
    assert texts.keys() == listed.keys()
    n = 0
    for conv, said in convs.items():
        r = found[conv]
        assert r.n_turns == len(said)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        loss = "".join(b for a, b in said if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        context, k, expanded = "", 0, 0
        for i, (a, b) in enumerate(said):
            piece, start, end = chat.piece(a, b)
            if a == "assistant":
                e = texts[conv, k]
                assert e.text == context + piece and e.turn == i
                assert e.text[e.loss_start : e.loss_end] == chat.escape(b)
                assert (e.context_chars, e.chars) == (len(context), len(context + piece))
                assert listed[conv, k][:7] == e[:7]
                k, n, expanded = k + 1, n + 1, expanded + len(e.text)
            context += piece
        assert (r.formatted_chars, r.n_examples, r.expanded_chars) == (len(context), k, expanded)
    assert n == len(texts)


def test_a_conversation_of_most_rows_goes_to_several_tasks(spark):
    rows = spark.range(4000).selectExpr("if(id % 10 = 0, id, 5L) as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "repeat('x', 50) as text")
    chunks = chat.formatted(rows)
    assert chunks.where("conv_id = 5").select("part").distinct().count() > 2
    got = chat.examples(chunks).where("conv_id = 5").orderBy("example").collect()
    assert [r.example for r in got] == list(range(2000))
    assert all(b.context_chars > a.context_chars for a, b in zip(got, got[1:], strict=False))
    assert chat.digests(chunks).where("conv_id = 5").first().n_turns == 3600


def test_one_row_that_repeats(spark):
    chunks = chat.formatted(spark.range(500).selectExpr("1L as conv_id", "0 as turn", "'assistant' as role", "'a#' as text"))
    assert chunks.select("part").distinct().count() > 1
    r = chat.digests(chunks).first()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (500, 1000, hashlib.sha256(b"a#" * 500).hexdigest())


def test_no_turns(spark):
    chunks = chat.formatted(spark.createDataFrame([], SCHEMA))
    assert chat.digests(chunks).collect() == [] and chat.examples(chunks).collect() == []


def stored(spark, since):
    """Files under the shared folder that were written since ``since``, as one table for each kind."""
    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    return {d.name.rpartition("-")[0]: str(d) for d in sorted(root.iterdir(), key=lambda d: d.stat().st_mtime_ns) if d.stat().st_mtime_ns > since}


@pytest.mark.parametrize("chunk", [1 << 20, 300])
def test_every_example_is_written_with_its_prefix(spark, turns, monkeypatch, chunk):
    """Prefix and target of each reply stand in the files: of small conversations in a row, of cut ones in pieces."""
    monkeypatch.setattr(chat, "CHUNK", chunk)
    since = time.time_ns()
    found = chat.digests(chat.formatted(turns)).collect()
    paths = stored(spark, since)
    texts = {}
    for r in spark.read.parquet(paths["chat"]).where("whole").collect():
        assert sum(len(e.text) for e in r.replies) <= chunk
        texts |= {(r.conv_id, k): (e.text, e.loss_start, e.loss_end) for k, e in enumerate(r.replies)}
    held = len(texts)
    pieces = {}
    for r in spark.read.parquet(paths["examples"]).where("example is not null").collect():
        pieces.setdefault((r.conv_id, r.example), []).append(r)
    for key, rows in pieces.items():
        rows.sort(key=lambda r: r.start)
        assert key not in texts and [r.start for r in rows] == [sum(len(q.text) for q in rows[:i]) for i in range(len(rows))]
        texts[key] = ("".join(r.text for r in rows), rows[0].loss_start, rows[0].loss_end)
    assert held > 0 and len(texts) > held and (chunk > 300 or max(map(len, pieces.values())) > 20)
    want = {}
    for conv, said in plain(rows_of()).items():
        context, k = "", 0
        for role, text in said:
            formatted, start, end = chat.piece(role, text)
            if role == "assistant":
                want[conv, k] = (context + formatted, len(context) + start, len(context) + end)
                k += 1
            context += formatted
    assert texts == want
    assert sum(r.expanded_chars for r in found) == sum(len(t) for t, *_ in texts.values())

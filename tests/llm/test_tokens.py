"""Byte-level BPE and rANS token files, against the public libraries and as exact round trips."""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wavelattice.llm import bpe, pretokens, queries, rans, slicecache

from .edge import documents, hash_twins, plain

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    with open(RANKS, "rb") as f:
        return bpe.Vocabulary(f.read())


ODD = st.text(alphabet=st.sampled_from("ab1 \n\t'sdtrelvm.,é日🙂  \x00²"), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(ODD, max_size=5))
def test_slices_match_the_pattern(texts):
    import regex

    assert pretokens.slices(texts) == [regex.findall(public_tokenizers.PATTERN, t) for t in texts] if texts else True


@settings(max_examples=100, deadline=None)
@given(texts=st.lists(ODD, min_size=1, max_size=4))
def test_ids_match_the_library(reference, vocabulary, texts):
    ids, counts = vocabulary.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [reference.encode_ordinary(t) for t in texts]
    assert vocabulary.decode(ids)[0].tobytes() == "".join(texts).encode()


def test_long_slices_merge_like_short_ones(reference):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    rng = np.random.default_rng(0)
    for n in (49, 200, 3000):
        piece = "".join(rng.choice(list("abcdeth"), n))
        assert bpe.merge(piece.encode(), ranks) == reference.encode_ordinary(piece)


def test_words_that_share_a_hash_are_told_apart(spark, reference, vocabulary):
    a, b = hash_twins()
    points = np.frombuffer((a + b).encode("utf-32-le"), np.uint32)
    found = slicecache.slice_hashes(points, np.array([0, len(a)]), np.array([len(a), len(a) + len(b)]))
    assert a != b and found[0] == found[1]
    texts = [f"x {a} y {b} z", b, f"{b}, {a}", a, "other"]
    for _ in range(2):
        ids, counts = vocabulary.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [reference.encode_ordinary(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows_of(rans.token_files(docs, public_tokenizers.path("byte_bpe_50k.json"))) == expected(docs)
    made = bpe.decode(bpe.encode(docs, RANKS, offsets="ends"), RANKS, offsets="ends").collect()
    assert {r["doc_id"]: (r["ids"], bytes(r["decoded"]).decode()) for r in made} == {i: (reference.encode_ordinary(t), t) for i, t in enumerate(texts)}


def test_cache_starts_anew_without_a_change_of_ids(vocabulary, reference, monkeypatch):
    monkeypatch.setattr(slicecache, "MAX_ENTRIES", 3)
    for texts in (["one two three"], ["four five six one"], ["two seven"], ["one two three"]):
        assert vocabulary.encode(texts)[0].tolist() == reference.encode_ordinary(texts[0])


def test_offsets_that_do_not_fit_fail(spark):
    df = bpe.encode(spark.createDataFrame([(1, "some words here")], "doc_id long, text string"), RANKS, offsets="ends")
    wrong = df.withColumn("ends", F.transform("ends", lambda e: e + 1))
    with pytest.raises(Exception, match="do not fit"):
        bpe.decode(wrong, RANKS, offsets="ends").collect()


def test_long_texts_are_cut_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_CHARS", 50)
    texts = ["word " * n for n in (0, 1, 400, 3, 2, 700)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = bpe.decode(bpe.encode(df, RANKS, offsets="ends"), RANKS, offsets="ends").collect()
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in rows} == dict(enumerate(texts))


def test_slices_of_every_code_point_give_the_ids_of_both_libraries(reference, vocabulary):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, tokenizer = rans.LibraryEncoder(path), Tokenizer.from_file(path)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"ab{chr(c)}1 {chr(c)}'s" for c in points[at : at + 512]) for at in range(0, len(points), 512)]
    for at in range(0, len(texts), 256):
        part = texts[at : at + 256]
        want = [e.ids for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        ids, counts = encoder.encode(part)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
        ids, counts = vocabulary.encode(part)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [reference.encode_ordinary(t) for t in part]


def test_unknown_ids_fail(vocabulary):
    with pytest.raises(ValueError):
        vocabulary.decode(np.array([60_000]))


@pytest.mark.parametrize("name", ["op6_byte_bpe"])
def test_bpe_query(spark, data, reference, name):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    found = {r["doc_id"]: r for r in queries.QUERIES[name](spark, data).collect()}
    assert len(found) == docs.count()
    for key, text in plain(docs):
        ids = reference.encode_ordinary(text)
        r = found[key]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_on_odd_rows(spark, reference):
    docs = documents(spark)
    made = bpe.decode(bpe.encode(docs, RANKS, offsets="ends", decoded="again"), RANKS)
    assert set(docs.columns) < set(made.columns)
    rows = made.collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = r["text"] or ""
        assert r["ids"] == reference.encode_ordinary(text)
        assert bytes(r["decoded"]) == bytes(r["again"]) == text.encode()
        assert (r["ends"][-1:] or [0]) == [len(text.encode())]
    assert bpe.encode(documents(spark, empty=True), RANKS).count() == 0


# ---------------------------------------------------------------- rANS


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=2000))
def test_blocks_round_trip(values):
    ids = np.array(values)
    coder = rans.Coder(rans.scaled_frequencies(np.bincount(ids)))
    for lanes in (1, 7, 1024):
        assert (coder.decode(coder.encode(ids, lanes), ids.size) == ids).all()


def test_size_is_near_the_entropy():
    p = 0.5 ** np.arange(1, 16)
    ids = np.random.default_rng(0).choice(15, 200_000, p=p / p.sum())
    counts = np.bincount(ids)
    share = counts[counts > 0] / ids.size
    coder = rans.Coder(rans.scaled_frequencies(counts))
    assert len(coder.encode(ids, 8)) * 8 < ids.size * -(share * np.log2(share)).sum() * 1.01 + 1000


def test_frequencies_keep_rare_symbols():
    counts = np.array([10**9, 1, 0, 1])
    freq = rans.scaled_frequencies(counts, 8)
    assert freq.sum() == 256 and freq[1] == freq[3] == 1 and freq[2] == 0
    assert rans.scaled_frequencies(np.ones(200), 8).sum() == 256
    with pytest.raises(ValueError):
        rans.scaled_frequencies(np.ones(300), 8)


def test_damage_is_found(tmp_path):
    ids = np.random.default_rng(0).integers(0, 50, 5000)
    coder = rans.Coder(rans.scaled_frequencies(np.bincount(ids)))
    part = {"doc_id": np.array([1]), "valid": np.array([1], np.uint8), "n": np.array([5000]), "ids": ids}
    path = tmp_path / "x.rans"
    data = bytearray(b"".join(rans.encode_file([part], coder)))
    path.write_bytes(data)
    assert (np.concatenate(list(rans.read_tokens(str(path), coder))) == ids).all()
    assert (np.concatenate(list(rans.read_tokens(str(path), coder, 100, 4200))) == ids[100:4200]).all()
    data[600] ^= 1
    path.write_bytes(data)
    with pytest.raises(ValueError):
        list(rans.read_tokens(str(path), coder))


def text_hash(text):
    h = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def expected(docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, out = 0, []
    for key, text in sorted(plain(docs), key=lambda r: (r[0] is not None, r[0] or 0, text_hash(r[1]), r[1])):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def rows_of(df):
    return sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in df.collect()), key=lambda r: r[1])


def test_token_file_query(spark, data):
    assert rows_of(queries.op1_rans_tokens(spark, data)) == expected(spark.read.parquet(f"{data}/documents.parquet"))


def test_token_files_of_odd_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert rows_of(rans.token_files(documents(spark), path)) == expected(documents(spark))
    assert rans.token_files(documents(spark, empty=True), path).count() == 0


def test_repeated_keys_go_to_several_files(spark, tmp_path):
    rows = [(5, f"text {i}") for i in range(40)] + [(5, "same")] * 40 + [(None, "none")] * 40 + [(9, "last")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = f"file://{tmp_path}/t"
    index = rans.write_token_files(df, public_tokenizers.path("byte_bpe_50k.json"), folder)
    assert len(index) == 4 and max(e["rows"] for e in index) < 60
    assert rows_of(rans.read_token_files(spark, folder, index)) == expected(df)


def test_added_tokens_are_encoded_as_the_library_does(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["a<|endoftext|>b", "plain text", "", "<|endoftext|>", "x <|endoftext|> <|endoftext|>y", "<|endoftext", "last"]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(want[0]) == 3
    ids, counts = rans.LibraryEncoder(path).encode(texts)
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    rows = rows_of(rans.token_files(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path))
    assert [r[2:] for r in rows] == [(len(w) + 1, zlib.crc32(np.array([*w, 0], "<u4").tobytes())) for w in want]

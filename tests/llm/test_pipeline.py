"""The pipeline, stage by stage against brute force, and as a whole."""

from __future__ import annotations

import base64
import importlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

from wavelattice.llm import mixing, shared

from .edge import documents
from .test_texts import brute_classes, brute_quality, brute_spans

pipeline = importlib.import_module("corpus_pipeline")
STAGES = dict(pipeline.STAGES)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def test_quality_keeps_whole_rows(spark, data, docs):
    kept = pipeline.quality(spark, docs, data)
    assert kept.columns == docs.columns
    rows, before = Counter(map(tuple, kept.collect())), Counter(map(tuple, docs.collect()))
    assert not rows - before and 0.5 * docs.count() < kept.count() < docs.count()


@pytest.mark.parametrize("odd", [False, True])
def test_near_duplicates_leave_one_of_each_class(spark, data, docs, odd):
    given = documents(spark) if odd else docs
    rows = [(r["doc_id"], r["text"] or "") for r in given.collect()]
    kept = pipeline.near_duplicates(spark, given, data)
    assert kept.columns == given.columns
    found = Counter((r["doc_id"], r["text"] or "") for r in kept.collect())
    _, groups = brute_classes(rows)
    assert sum(found.values()) == len(groups)
    for g in groups:
        keys = [rows[i][0] for i in g if rows[i][0] is not None]
        held = [rows[i] for i in g if found[rows[i]]]
        assert held and all(r[0] == (min(keys) if keys else None) for r in held)


def test_unrelated_texts_of_one_key_both_stay(spark, data):
    rows = [(5, "one text of its own", "en", "a", 1), (5, "another that is not alike", "en", "a", 1), (6, "a third", "en", "a", 1)]
    kept = pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), data)
    assert sorted(map(tuple, kept.collect())) == sorted(rows)


def test_secrets_are_hidden_and_nothing_else(spark, data, docs):
    given = documents(spark)
    for df in (docs, given):
        out = pipeline.secrets(spark, df, data)
        assert out.columns == df.columns and out.count() == df.count()
        texts = [r["text"] for r in out.collect()]
        assert not any(brute_spans(t or "") for t in texts)
        clean = Counter(r["text"] for r in df.collect() if not brute_spans(r["text"] or ""))
        assert sum((clean - Counter(texts)).values()) <= 1  # a span that only the method finds


def test_quality_decides_by_brute_force(spark, tmp_path):
    given = documents(spark).where("length(text) < 300 or text is null")
    rows = [(r["doc_id"], r["text"] or "", r["lang"]) for r in given.collect()]
    labels = [(k, 1) for k in range(0, 18) if k != 6] + [(6, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = pipeline.quality(spark, given, str(tmp_path))
    assert kept.columns == given.columns
    _, _, keep = brute_quality(rows, labels)
    assert Counter((r["doc_id"], r["text"] or "", r["lang"]) for r in kept.collect()) == Counter(r for r, k in zip(rows, keep, strict=True) if k)


@pytest.mark.parametrize("odd", [False, True])
def test_source_mix_repeats_rows_as_the_mix_says(spark, data, docs, odd):
    given = documents(spark) if odd else docs
    out = pipeline.source_mix(spark, given, data)
    assert out.columns == given.columns
    want = Counter()
    for r in mixing.mix(given).collect():
        want[tuple(r[c] if c != "size" else 7 for c in COLUMNS)] += r["copies"]
    found = Counter(tuple(r[c] for c in COLUMNS) for r in out.collect())
    assert found == +want


@pytest.mark.parametrize("odd", [False, True])
def test_token_ids_are_the_librarys(spark, data, docs, odd):
    given = documents(spark) if odd else docs
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((r["doc_id"], tuple(library.encode_ordinary(r["text"] or ""))) for r in given.collect())
    rows = pipeline.token_ids(spark, given, data).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == want
    assert all(r["exact"] and r["n_tokens"] == len(r["ids"]) for r in rows)


def test_many_rows_of_one_text_without_keys(spark, data, monkeypatch):
    monkeypatch.setattr(shared, "MOST_BROADCAST", 0)
    rows = [(None, "some text that is shared with token = abcdefgh12345 in it", "en", "a", 1)] * 300 + [(i, f"text {i}", "en", "a", 1) for i in range(30)]
    given = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert pipeline.near_duplicates(spark, given, data).count() == 31
    out = pipeline.secrets(spark, given, data).collect()
    assert len(out) == 330 and sum("[SECRET]" in r["text"] for r in out) == 300


def test_every_stage_takes_an_empty_table(spark, data):
    empty = documents(spark, empty=True)
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, data).count() == 0, name


def test_run(spark, data, docs):
    rows = pipeline.run(spark, data).collect()
    assert rows and all(r["exact"] and r["n_tokens"] == len(r["ids"]) for r in rows)
    assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert max(Counter(r["doc_id"] for r in rows).values()) <= 3
    assert importlib.import_module("__spark_entry__").queries()["pipeline"] is pipeline.run

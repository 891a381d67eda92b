"""Spelling variants against brute force."""

from __future__ import annotations

import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavelattice.llm import variants


def near(a: str, b: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows, least=5):
    counts = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] = counts.get(run, 0) + 1
    counts = {w: n for w, n in counts.items() if n >= least}
    about = {w: [o for o in counts if near(w, o)] for w in counts}
    form = {}
    for w, others in about.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(about[w]), counts.get(form[w])))
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abé", max_size=7), max_size=40))
def test_near_pairs_are_those_of_brute_force(words):
    words = sorted(words)
    found = sorted(tuple(sorted(p)) for p in variants.near_pairs(words))
    assert found == sorted((i, j) for j in range(len(words)) for i in range(j) if near(words[i], words[j]))


@pytest.mark.parametrize("most", [(2048, 1 << 16), (3, 1 << 16), (1, 1 << 16), (2048, 40)])
def test_links_whatever_the_size_of_subtrees(spark, most):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(0, 8))) for _ in range(150)} | {"a" * 30, "a" * 31, "a" * 29 + "b"})
    table = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    found = variants.links(table, *most).collect()
    assert sorted(tuple(sorted((r.a, r.b))) for r in found) == sorted((a, b) for b in words for a in words if a < b and near(a, b))
    assert all(words[r.an] == r.a and words[r.bn] == r.b for r in found)


def test_variants_of_documents(spark):
    rng = random.Random(3)
    stems = ["separate", "definitely", "École×française", "occurrence", "aaaaaaa", "necessary"]
    rows = []
    for k in range(300):
        words = [rng.choice(stems[: 1 + k % 6]) for _ in range(40)]
        for i in range(0, 40, 5):
            w, p = words[i], rng.randrange(6)
            words[i] = rng.choice([w[:p] + w[p + 1 :], w[:p] + "q" + w[p:], w[:p] + "Q" + w[p + 1 :], w.upper()])
        rows.append((k, " ".join(words)))
    rows += [(None, "separate " * 7), (None, None), (7, ""), (7, "separate " * 7), (7, "separate " * 7), (8, "x" * 50_000), (9, "12 \U0001d518 short")]
    rows += [(10 + k, ("y" * 3000 + " ") * 5 + ("y" * 3001 + " ") * 30) for k in range(2)]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    found = sorted(tuple(r) for r in variants.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert found == expected(rows)
    assert any(r[1] and r[2] != r[1] for r in found) or any(r[1] for r in found)


def test_chains_lead_to_the_last_form(spark):
    words = spark.createDataFrame([("aaaaaa", 5), ("aaaaab", 25), ("aaaabb", 125), ("aaabbb", 625), ("zzzzzz", 5), ("aaabbc", 624)], "word string, n long")
    found = {r.word: (r.form, r.root, r.n_near, r.form_n) for r in variants.forms(words, variants.links(words)).collect()}
    assert found["aaaaaa"] == ("aaaaab", "aaabbb", 1, 25)
    assert found["aaaabb"] == ("aaabbb", "aaabbb", 2, 625)
    assert found["aaabbc"] == (None, "aaabbc", 1, None)
    assert found["zzzzzz"] == (None, "zzzzzz", 0, None)


def test_ties_take_the_first_word(spark):
    words = spark.createDataFrame([("aaaaaa", 5), ("aaaaac", 50), ("aaaaab", 50)], "word string, n long")
    found = {r.word: r.form for r in variants.forms(words, variants.links(words)).collect()}
    assert found == {"aaaaaa": "aaaaab", "aaaaab": None, "aaaaac": None}


def test_an_empty_table_has_no_words(spark):
    assert variants.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []

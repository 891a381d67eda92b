"""A small table with every odd case: nulls, empty and long texts, repeated rows, ties, clashing column names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, size long, keep string, perplexity string, _bucket int, _ident string, _n int, _key string, _spans string, _fixed int, _doc int, _file int, _chunk string, _ck int"


def hash_twins(n: int = 2048) -> tuple[str, str]:
    """Two words that share every polynomial hash modulo 2^64 with an odd base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def documents(spark, *, empty: bool = False):
    rng = random.Random(3)
    words = ["ka", "lo", "mira", "ten", "os", "vel", "unta", "pri", "dor", "esk", "an", "tho", "rin", "gal"]

    def prose(n: int) -> str:
        return " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))

    base = prose(60)
    near = base.split()
    near[30] = "changed"
    secret = 'x token = "0123456789abcdef0123456789abcdef01234567" y'
    texts = [
        base,
        base,
        " ".join(near),
        None,
        "",
        " \n\t ",
        "one",
        "one two three four",
        prose(4000),
        "a" * 5000,
        secret,
        "Héé 日本語 🙂 can't  we'll  ١٢٣ x\r\n",
        prose(30),
        prose(45),
        "Released under the MIT License.",
        "tab\tand\x00nul",
        "special <|endoftext|> string",
        "一刀嘀 一刀嘀 \U0001f600\U00020000 漢字",
        "twin " + " ".join(hash_twins()),
    ]
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None)[i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[0], rows[3], (0, "another text of the first key", "en", "a", 1), (None, prose(12), "en", "a", 1), (None, None, None, None, None)]
    rows = [(*r, "x", 7, "k", "p", 1, "i", 2, "y", "s", 3, 4, 5, "c", 6) for r in rows]
    return spark.createDataFrame([] if empty else rows, SCHEMA)


def plain(df):
    """Texts as the operators see them, with their keys."""
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]

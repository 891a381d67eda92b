"""Digests, manifests, leak scans, gates and long tables of metrics."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import LEAKS, custom_order, leak_counts


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def manifest(df: DataFrame, name: str, content: str) -> DataFrame:
    """``name, bytes, sha256`` of a text or binary column."""
    return df.select(name, F.octet_length(F.col(content)).cast("long").alias("bytes"), digest(F.col(content)).alias("sha256"))


def manifest_difference(expected: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """``name, status`` of what is missing, extra or changed."""
    a, b = expected.select(name, F.col("sha256").alias("_a")), found.select(name, F.col("sha256").alias("_b"))
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, name, "full").select(name, status.alias("status")).where("status is not null")


def lines_digest(df: DataFrame, line: str, order: list[str] | None = None) -> DataFrame:
    """SHA-256 of all lines, each ended; sorted, or in a stated order. Null lines are left out.

    A digest of one text cannot be formed in parts, so one task reads the lines in order from a sort that spills to
    disk; it holds a batch of them at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        found, seen = hashlib.sha256(), False
        for batch in batches:
            for value in batch.column(0).to_pylist():
                found.update(value.encode("utf-8", "replace") + b"\n")
                seen = True
        if seen:
            yield pa.RecordBatch.from_pydict({"sha256": [found.hexdigest()]})

    keys = [F.col(f"_o{i}").asc_nulls_last() for i in range(len(order or []))]
    lines = df.select(F.col(line).cast("string").alias("_line"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order or []))).where("_line is not null")
    digests = lines.repartition(1).sortWithinPartitions(*keys, "_line").select("_line").mapInArrow(run, "sha256 string")
    return digests.agg(F.coalesce(F.max("sha256"), F.lit(hashlib.sha256(b"\n").hexdigest())).alias("sha256"))


def leak_scan(df: DataFrame, text: str, by: list[str]) -> DataFrame:
    """``by, rule, n_hits, n_rows`` for every rule, in one pass."""
    counts = leak_counts(F.coalesce(F.col(text), F.lit("")))
    hits = df.select(*by, *(c.alias(n) for n, c in counts.items()))
    sums = hits.groupBy(*by).agg(*(a for n in counts for a in (F.sum(n).alias(f"h_{n}"), F.count_if(F.col(n) > 0).alias(f"r_{n}"))))
    rows = [F.struct(F.lit(n).alias("rule"), F.col(f"h_{n}").alias("n_hits"), F.col(f"r_{n}").alias("n_rows")) for n in counts]
    return sums.select(*by, F.explode(F.array(*rows)).alias("r")).select(*by, "r.*")


def file_class(path: Column, leaked: Column) -> Column:
    """Private, candidate or manual review by a path's words; a candidate with a leak goes to review."""
    low = F.lower(path)
    private = low.rlike(r"(patient|subject|record|credential|secret)")
    candidate = low.rlike(r"\.(py|md|json|csv|txt|html)$")
    return F.when(private, "PRIVATE").when(candidate & ~leaked, "CANDIDATE").otherwise("MANUAL_REVIEW")


@dataclass(frozen=True)
class FileRule:
    """Why a path is of a class: it meets every condition that is not empty. ``words`` stand in the name, or as a whole
    folder in the path; ``path_words`` anywhere in the path; case does not matter, but in ``names``."""

    reason: str
    suffixes: tuple[str, ...] = ()
    words: tuple[str, ...] = ()
    path_words: tuple[str, ...] = ()
    prefix: str = ""
    names: tuple[str, ...] = ()

    def met(self, path: Column) -> Column:
        low = F.lower(path)
        name = F.regexp_extract(low, r"[^/]*$", 0)
        out = F.lit(True)
        if self.suffixes:
            out = out & F.regexp_extract(name, r".(\.[^.]*)$", 1).isin(*self.suffixes)
        if self.words:
            out = out & reduce(or_, (name.contains(w) | F.concat(F.lit("/"), low, F.lit("/")).contains(f"/{w}/") for w in self.words))
        if self.path_words:
            out = out & reduce(or_, (low.contains(w) for w in self.path_words))
        if self.prefix:
            out = out & low.startswith(self.prefix)
        if self.names:
            out = out & F.regexp_extract(path, r"[^/]*$", 0).isin(*self.names)
        return out


PRIVATE_RULES = (
    FileRule("raw array suffix", suffixes=(".npz", ".npy", ".dat", ".hea", ".pkl", ".pickle", ".parquet", ".feather", ".h5", ".hdf5", ".mat")),
    FileRule("private, patient-level, checkpoint or log naming", words=("private", "checkpoint", "checkpoints", "logs", "log", "patient_level")),
    FileRule("restricted source data", path_words=("chartevents", "clinical-database")),
    FileRule("patient-level scores", words=("patient_scores",)),
)
CANDIDATE_RULES = (
    FileRule("known aggregate", names=("README.md", "CITATION.cff", "LICENSE")),
    FileRule("scientific, audit or publication code", prefix="code/", suffixes=(".py", ".sh", ".md")),
    FileRule("frozen specification", prefix="freeze/", suffixes=(".json", ".md", ".txt")),
    FileRule("candidate aggregate result", path_words=("results/",), suffixes=(".json", ".txt", ".md", ".csv"), words=("summary", "readout", "aggregate", "cohort", "axis_reliability")),
)


def classified_files(files: DataFrame, path: str = "path", private: tuple[FileRule, ...] = PRIVATE_RULES, candidate: tuple[FileRule, ...] = CANDIDATE_RULES) -> DataFrame:
    """``files`` with ``file_class`` (PRIVATE, CANDIDATE or MANUAL_REVIEW) and ``reason``, that of the first rule which the
    path meets; private rules come before candidates. A null path goes to review."""
    first = lambda rules: F.coalesce(*(F.when(r.met(F.col(path)), F.lit(r.reason)) for r in rules))
    why, may = first(private), first(candidate)
    return files.withColumns({"file_class": F.when(why.isNotNull(), "PRIVATE").when(may.isNotNull(), "CANDIDATE").otherwise("MANUAL_REVIEW"), "reason": F.coalesce(why, may, F.lit(""))})


# What a release must not hold, beside the patterns of texts.
RAW_SUFFIXES = ["npz", "npy", "dat", "hea", "wfdb", "gz", "pkl", "pickle"]
TEXT_SUFFIXES = ["md", "txt", "json", "csv", "cff", "py", "sh", "yaml", "yml", "toml"]
ID_COLUMNS = ["patient_id", "subject_id", "hadm_id", "icustay_id", "record_id", "record_path", "case_id"]
LARGE_BYTES = 20 * 1024 * 1024
PATH_RULES, SECRET_RULES = ["mac_path", "home_path", "windows_path"], ["hub_token", "hub_pat", "private_key", "access_key"]


def release_findings(files: DataFrame, *, path: str = "path", size: str = "bytes", text: str = "text") -> DataFrame:
    """``path, rule`` for every rule that a file breaks: raw_suffix, large, local_path, secret, identifier, id_column.

    Texts are searched in files of the text suffixes; concrete identifiers may stand in Python code; an id column is a
    name in the first line of a CSV, whatever its case.
    """
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    body = F.when(suffix.isin(TEXT_SUFFIXES), F.coalesce(F.col(text), F.lit(""))).otherwise(F.lit(""))
    any_of = lambda names: sum((F.regexp_count(body, F.lit(LEAKS[n])) for n in names), F.lit(0)) > 0
    names = F.transform(F.split(F.substring_index(body, "\n", 1), ","), lambda c: F.lower(F.trim(F.regexp_replace(c, r'^[\s"]+|[\s"]+$', ""))))
    rules = {
        "raw_suffix": suffix.isin(RAW_SUFFIXES),
        "large": F.col(size) > LARGE_BYTES,
        "local_path": any_of(PATH_RULES),
        "secret": any_of(SECRET_RULES),
        "identifier": (suffix != "py") & any_of(["patient_id"]),
        "id_column": (suffix == "csv") & F.arrays_overlap(names, F.array(*(F.lit(c) for c in ID_COLUMNS))),
    }
    broken = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())), lambda r: r.isNotNull())
    return files.select(path, F.explode(broken).alias("rule"))


def keyword_candidates(files: DataFrame, path: str, words: dict[str, list[str]]) -> DataFrame:
    """``path, kind`` for every kind of which a path holds one of the words, whatever its case."""
    low = F.lower(path)
    kinds = []
    for kind, own in words.items():
        met = F.lit(False)
        for w in own:
            met = met | low.contains(w.lower())
        kinds.append(F.when(met, F.lit(kind)))
    return files.select(path, F.explode(F.filter(F.array(*kinds), lambda k: k.isNotNull())).alias("kind"))


def matrix_facts(matrix: DataFrame) -> DataFrame:
    """``n_rows, n_columns, n_elements, whole, finite, symmetry_error`` of a matrix as ``i, j, c`` (zero-based)."""
    good = F.col("c").isNotNull() & ~F.isnan("c") & (F.abs(F.col("c")) < float("inf"))
    one = matrix.agg((F.max("i") + 1).alias("n_rows"), (F.max("j") + 1).alias("n_columns"), F.count("*").alias("n_elements"), F.bool_and(good).alias("finite"))
    other = matrix.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("c").alias("_t"))
    error = matrix.join(other, ["i", "j"]).agg(F.max(F.abs(F.col("c") - F.col("_t"))).alias("symmetry_error"))
    whole = F.col("n_elements") == F.col("n_rows") * F.col("n_columns")
    return one.crossJoin(F.broadcast(error)).select("n_rows", "n_columns", "n_elements", whole.alias("whole"), "finite", "symmetry_error")


def orthonormal_error(basis: DataFrame) -> DataFrame:
    """``error``: the largest difference between the products of a basis' columns (``i, j, c``) and the unit matrix."""
    other = basis.select("i", F.col("j").alias("k"), F.col("c").alias("_d"))
    gram = basis.join(other, "i").groupBy("j", "k").agg(F.sum(F.col("c") * F.col("_d")).alias("g"))
    return gram.agg(F.max(F.abs(F.col("g") - (F.col("j") == F.col("k")).cast("double"))).alias("error"))


def largest_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """``difference`` of two matrices as ``i, j, c``; elements that one lacks count as infinite."""
    joined = a.select("i", "j", F.col("c").alias("_a")).join(b.select("i", "j", F.col("c").alias("_b")), ["i", "j"], "full")
    return joined.agg(F.max(F.coalesce(F.abs(F.col("_a") - F.col("_b")), F.lit(float("inf")))).alias("difference"))


def output_lock(result: DataFrame, identity: dict[str, object], outputs: DataFrame, required: list[str], *, name: str = "name", content: str = "content") -> DataFrame:
    """The manifest of the required outputs; fails where one is missing or the one-row ``result`` is not as it must be."""
    row = result.first()
    wrong = [k for k, v in identity.items() if row is None or k not in row or row[k] != v]
    if wrong:
        raise ValueError(f"the result is not the one to be locked: {wrong}")
    found = manifest(outputs.where(F.col(name).isin(required)), name, content)
    missing = sorted(set(required) - {r[name] for r in found.select(name).collect()})
    if missing:
        raise ValueError(f"outputs are missing: {missing}")
    return found


def locked_inputs(expected: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """``found`` if every expected name has the expected digest; else fails with the names that differ."""
    wrong = manifest_difference(expected, found, name).where("status <> 'extra'").orderBy(name).limit(10).collect()
    if wrong:
        raise ValueError(f"inputs differ from the locked ones: {[(r[name], r['status']) for r in wrong]}")
    return found


def figure_ready(metrics: DataFrame, names: list[str], expected: dict[str, str] | None = None) -> DataFrame:
    """The rows of the named metrics in the stated order; fails where one is missing or a column has another type."""
    if expected is not None and (wrong := {c: dict(metrics.dtypes).get(c) for c, t in expected.items() if dict(metrics.dtypes).get(c) != t}):
        raise ValueError(f"columns of another type or missing: {wrong}")
    metric_lookup(metrics, names)
    return metrics.where(F.col("metric").isin(names)).withColumn("place", custom_order(F.col("metric"), names))


METRIC = ["section", "metric", "value", "unit", "role", "source", "note"]


def metric_rows(df: DataFrame, section: str, *, unit: str = "", role: str = "", source: str = "", note: str = "") -> DataFrame:
    """A one-row table of numbers as rows of the long table."""
    rows = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns]
    out = df.select(F.explode(F.array(*rows)).alias("r"))
    fixed = {"section": section, "unit": unit, "role": role, "source": source, "note": note}
    return out.select("r.*", *(F.lit(v).alias(k) for k, v in fixed.items())).select(*METRIC)


def metric_lookup(metrics: DataFrame, names: list[str]) -> DataFrame:
    """One row with the named metrics as columns; fails where one is missing or repeats."""
    row = metrics.agg(*(F.count_if(F.col("metric") == n).alias(f"n{i}") for i, n in enumerate(names))).first()
    wrong = [n for n, k in zip(names, row, strict=True) if k != 1]
    if wrong:
        raise ValueError(f"metrics missing or repeated: {wrong}")
    return metrics.agg(*(F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names))


def gate(conditions: dict[str, bool], done: str = "PASS") -> str:
    """``done`` where every condition holds, else the names of those that fail."""
    failed = [n for n, ok in conditions.items() if not ok]
    return done if not failed else "FAIL: " + ", ".join(failed)


def replayed(found: DataFrame, frozen: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """``key, difference, passed`` of numbers against frozen ones; what is missing on either side fails."""
    joined = found.select(key, F.col(value).alias("_a")).join(frozen.select(key, F.col(value).alias("_b")), key, "full")
    diff = F.abs(F.col("_a") - F.col("_b"))
    return joined.select(key, diff.alias("difference"), F.coalesce(diff <= tolerance, F.lit(False)).alias("passed"))

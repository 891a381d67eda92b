"""Readers and writers: typed CSV, matrices, waveform archives, inventories of files."""

from __future__ import annotations

import csv
import io
import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lower_header(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.strip().lower() for c in df.columns))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A CSV with a header; all strings without a schema. Names are matched without case and outer blanks.

    With a schema, values that do not parse become null, and columns that are not named are not read.
    """
    raw = lower_header(spark.read.option("header", True).csv(path))
    if schema is not None:
        kinds = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        raw = raw.select(*(F.col(f.name.lower()).try_cast(f.dataType).alias(f.name) for f in kinds))
    return raw.select(*columns) if columns else raw


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def read_texts(spark: SparkSession, path: str, most_bytes: int | None = None, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """``path, text`` of all files, or of those up to a size or with a suffix; bytes that are no UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    if most_bytes is not None:
        files = files.where(F.col("length") <= most_bytes)
    if suffixes:
        files = files.where(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin([s.lower() for s in suffixes]))
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


def header(spark: SparkSession, path: str) -> list[str]:
    """Names of a CSV's columns, from its first line alone."""
    first = spark.read.text(path).limit(1).collect()
    return _names(first[0][0]) if first else []


def _names(line: str) -> list[str]:
    return [c.strip() for c in next(csv.reader([line]), [])]


#: Suffixes under which a table may lie, in the order of preference.
TABLE_SUFFIXES = (".csv", ".csv.gz", ".csv.bz2", ".parquet")


def file_paths(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path`` of all files below a folder whose name matches, listed by Spark's own readers, which leave out empty ones."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path")


def locate_table(spark: SparkSession, folder: str, name: str, *, required: bool = True) -> str | None:
    """The file of a table in a folder, whatever its case, by the first suffix there is; null or an error for none."""
    held = F.lower(F.regexp_extract("path", r"([^/]+)$", 1))
    wanted = [name.lower() + s for s in TABLE_SUFFIXES]
    order = F.array_position(F.array(*(F.lit(w) for w in wanted)), held)
    found = file_paths(spark, folder).where(held.isin(wanted)).orderBy(order, "path").limit(1).collect()
    if found:
        return found[0]["path"]
    if required:
        raise FileNotFoundError(f"{folder} holds no table {name}")
    return None


def locate_named(spark: SparkSession, name: str, folders: list[str], explicit: str | None = None) -> tuple[str | None, list[str]]:
    """The first file of that name by path, and all of them; a path that is given goes before any search."""
    if explicit is not None:
        found = [r["path"] for r in spark.read.format("binaryFile").load(explicit).select("path").collect()] if _exists(spark, explicit) else []
    else:
        found = sorted({r["path"] for f in folders if _exists(spark, f) for r in file_paths(spark, f, name).distinct().collect()})
    return (found[0] if found else None), found


def locate_one(spark: SparkSession, folders: list[str], patterns: list[str]) -> str:
    """The one file that any of the patterns matches; fails where there is none or more than one."""
    found = sorted({r["path"] for f in folders if _exists(spark, f) for p in patterns for r in file_paths(spark, f, p).distinct().collect()})
    if len(found) != 1:
        raise FileNotFoundError(f"{len(found)} files match {patterns}: {found[:10]}")
    return found[0]


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def write_coordinates(df: DataFrame, path: str, ident: str, vectors: list[str]) -> None:
    """Coordinates (``ident`` and array columns) as one compressed artefact."""
    df.select(ident, *(F.col(v).cast("array<double>").alias(v) for v in vectors)).write.option("compression", "zstd").parquet(path)


def read_coordinates(spark: SparkSession, path: str, ident: str, vectors: list[str]) -> DataFrame:
    """Coordinates as they were written; fails where one of the columns is missing."""
    found = spark.read.parquet(path)
    missing = [c for c in (ident, *vectors) if c not in found.columns]
    if missing:
        raise ValueError(f"{path} lacks {missing}")
    return found.select(ident, *vectors)


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV with a header, a file for each partition; arrays and structs as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.option("header", True).csv(path)


def inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, bytes, sha256`` of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """``patient_id, fs, abp, failure`` of NumPy archives; an archive that lacks a key gives the reason."""

    def run(frames: Iterator[pd.DataFrame]):
        for frame in frames:
            rows = []
            for content, name in zip(frame["content"], frame["path"], strict=True):
                try:
                    with np.load(io.BytesIO(content), allow_pickle=False) as z:
                        signal = np.asarray(z["ABP"], float).ravel()
                        rows.append((str(z["patient_id"]), float(z["fs"]), signal.tolist(), None if np.isfinite(signal).any() else "no finite sample"))
                except (KeyError, ValueError, OSError) as e:
                    rows.append((None, None, None, f"{os.path.basename(name)}: {e}"))
            yield pd.DataFrame(rows, columns=["patient_id", "fs", "abp", "failure"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    return files.mapInPandas(run, "patient_id string, fs double, abp array<double>, failure string")


def matrix_to_long(df: DataFrame, row: str = "row") -> DataFrame:
    """``i, j, x`` of a wide table of numbers, rows by their column (from 1), columns in order."""
    values = F.array(*(F.col(f"`{c}`").cast("double") for c in df.columns if c != row))
    return df.select((F.col(row).cast("int") - 1).alias("i"), F.posexplode(values).alias("j", "x"))


def long_to_matrix(df: DataFrame, size: int, prefix: str = "p") -> DataFrame:
    """The wide table with rows and columns counted from 1."""
    wide = df.groupBy((F.col("i") + 1).alias("row")).pivot("j", list(range(size))).agg(F.first("x"))
    return wide.toDF("row", *(f"{prefix}{k + 1:02d}" for k in range(size)))


def write_document(path: str, value: dict | str) -> None:
    """A small JSON or text file, whole or not at all."""
    text = value if isinstance(value, str) else json.dumps(value, indent=2, sort_keys=True) + "\n"
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(f"{path}.tmp", path)


def markdown(df: DataFrame, most_rows: int = 200) -> str:
    """A small table as Markdown, numbers to six digits; fails where it has more than ``most_rows`` rows."""
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    lines = [df.columns, ["---"] * len(df.columns), *([cell(v) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines) + "\n"

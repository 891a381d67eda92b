"""Joins and tables that check what they assume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class GuardError(ValueError):
    """What a guard found."""


def expect_columns(df: DataFrame, names: list[str], *, exact: bool = False) -> DataFrame:
    """``df`` if it has the columns (``exact``: these only, in this order)."""
    missing = [n for n in names if n not in df.columns]
    if missing or (exact and df.columns != names):
        raise GuardError(f"columns {df.columns} do not match {names}")
    return df


def expect_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    found = {f.name: f.dataType for f in df.schema}
    wrong = [f.name for f in schema if found.get(f.name) != f.dataType]
    if wrong:
        raise GuardError(f"columns of another type or missing: {wrong}")
    return df


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, and how many rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def validated_join(left: DataFrame, right: DataFrame, keys: list[str], *, validate: str = "one_to_one", rows: int | None = None) -> DataFrame:
    """A left join that fails where keys repeat on a side that must be unique, or the row count is not ``rows``."""
    for side, df in (("left", left), ("right", right)):
        unique = validate == "one_to_one" or (side == "right" and validate == "many_to_one") or (side == "left" and validate == "one_to_many")
        if unique and not duplicate_keys(df, keys).isEmpty():
            raise GuardError(f"keys repeat on the {side} side")
    out = left.join(right, keys, "left")
    if rows is not None and (n := out.count()) != rows:
        raise GuardError(f"{n} rows instead of {rows}")
    return out


def missing_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of ``left`` that ``right`` lacks."""
    return left.select(*keys).distinct().join(right.select(*keys), keys, "left_anti")


def set_comparison(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys only in ``a``, only in ``b``, in both, and whether the sets are equal."""
    both = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full")
    out = both.agg(*(F.count_if(c).alias(n) for n, c in (("only_left", F.col("_b").isNull()), ("only_right", F.col("_a").isNull()), ("in_both", F.col("_a").isNotNull() & F.col("_b").isNotNull()))))
    return out.withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def first_of_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in a stated order."""
    from pyspark.sql import Window

    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def expectations(df: DataFrame, checks: dict[str, tuple[str, Column]]) -> DataFrame:
    """``name, category, n_failed, passed`` for each check (category and condition that every row must meet), in one pass."""
    row = df.agg(*(F.count_if(~F.coalesce(cond, F.lit(False))).alias(f"c{i}") for i, (_, cond) in enumerate(checks.values())))
    rows = [F.struct(F.lit(n).alias("name"), F.lit(cat).alias("category"), F.col(f"c{i}").alias("n_failed")) for i, (n, (cat, _)) in enumerate(checks.items())]
    return row.select(F.explode(F.array(*rows)).alias("r")).select("r.*").withColumn("passed", F.col("n_failed") == 0)


def manifest_checks(rows: DataFrame, label: str, expected: int, *, required: list[str], ident: str, rate: float, seconds: int, aliases: list[str], category: str = "required") -> DataFrame:
    """``name, category, passed, detail`` of a manifest's row checks, in one pass: fields, number of rows, different and
    blank ids, sampling rate (``fs``), length (``duration_sec``) and source names (``abp_source_name``).

    Values may be texts; what is no number, and a field that is missing, is bad. Ids and names are trimmed.
    """
    own = rows.columns
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in own else F.lit("")
    number = lambda c: F.expr(f"try_cast(`{c}` AS double)") if c in own else F.lit(None).cast("double")
    missing = sorted(set(required) - set(own))
    good = lambda c: F.coalesce(c, F.lit(False))
    one = rows.agg(
        F.count("*").alias("n"),
        F.count_distinct(F.when(text(ident) != "", text(ident))).alias("ids"),
        F.count_if(text(ident) == "").alias("blank"),
        F.count_if(~good(F.abs(number("fs") - rate) <= 1e-9)).alias("bad_fs"),
        F.count_if(~good(number("duration_sec") == seconds)).alias("bad_length"),
        F.count_if(~text("abp_source_name").isin(aliases)).alias("bad_alias"),
    )
    bad = lambda c: F.concat(F.lit("bad_rows="), c)
    checks = [
        ("required_fields", F.lit(not missing), F.lit("missing=" + ",".join(missing) if missing else "complete")),
        ("row_count", F.col("n") == expected, F.concat(F.lit("rows="), "n", F.lit(f" expected={expected}"))),
        ("unique_ids", F.col("ids") == expected, F.concat(F.lit("unique="), "ids", F.lit(f" expected={expected}"))),
        ("blank_ids", F.col("blank") == 0, F.concat(F.lit("blank="), "blank")),
        ("sampling_rate", F.col("bad_fs") == 0, bad("bad_fs")),
        ("duration", F.col("bad_length") == 0, bad("bad_length")),
        ("source_names", F.col("bad_alias") == 0, bad("bad_alias")),
    ]
    each = [F.struct(F.lit(f"{label}_{n}").alias("name"), F.lit(category).alias("category"), ok.alias("passed"), d.alias("detail")) for n, ok, d in checks]
    return one.select(F.explode(F.array(*each)).alias("r")).select("r.*")


def decision(checks: DataFrame) -> DataFrame:
    """``category, n_checks, n_failed, decision``: PASS where all checks of the category hold."""
    out = checks.groupBy("category").agg(F.count("*").alias("n_checks"), F.count_if(~F.col("passed")).alias("n_failed"))
    return out.withColumn("decision", F.when(F.col("n_failed") == 0, "PASS").otherwise("FAIL"))


def preflight_decision(checks: DataFrame, *, required: str = "required", future: str = "future") -> DataFrame:
    """``n_required_failed, n_future, n_future_failed, decision``: FAIL where a required check fails, PASS where all
    future ones hold as well (and there are any), else PARTIAL."""
    mine, later = F.col("category") == required, F.col("category") == future
    failed = ~F.coalesce(F.col("passed"), F.lit(False))
    out = checks.agg(F.count_if(mine & failed).alias("n_required_failed"), F.count_if(later).alias("n_future"), F.count_if(later & failed).alias("n_future_failed"))
    ready = (F.col("n_future") > 0) & (F.col("n_future_failed") == 0)
    return out.withColumn("decision", F.when(F.col("n_required_failed") > 0, "FAIL").when(ready, "PASS").otherwise("PARTIAL"))


def detect_column(columns: list[str], preferred: list[str], words: list[str]) -> str | None:
    """The first preferred column there is, whatever its case, else the first that holds all words."""
    low = {c.lower(): c for c in columns}
    return next((low[p.lower()] for p in preferred if p.lower() in low), next((c for c in columns if all(w.lower() in c.lower() for w in words)), None))


def pinned_column(df: DataFrame, column: str, valid: int, condition: Column | None = None) -> DataFrame:
    """``df`` if just ``valid`` rows of the column are valid (not null, or as ``condition`` says)."""
    expect_columns(df, [column])
    n = df.where(F.col(column).isNotNull() if condition is None else condition).count()
    if n != valid:
        raise GuardError(f"{n} valid rows of {column} instead of {valid}")
    return df


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, n_null, n_not_finite`` of the columns, in one pass."""
    types = dict(df.dtypes)
    aggs = []
    for i, c in enumerate(columns):
        odd = (F.isnan(c) | (F.abs(F.col(c)) == float("inf"))) if types[c] in ("double", "float") else F.lit(False)
        aggs += [F.count_if(F.col(c).isNull()).alias(f"n{i}"), F.count_if(odd).alias(f"f{i}")]
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_null"), F.col(f"f{i}").alias("n_not_finite")) for i, c in enumerate(columns)]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")

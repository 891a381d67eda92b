"""Scalar rules: identifiers, codes, dates, ages, folds, bands, text patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FOLD_SALT = "20260820:"
YEAR_SECONDS = 365.2425 * 86_400


def trailing_id(c: Column) -> Column:
    """The digits at the end as a number; null where there are none or too many."""
    return F.regexp_extract(c, r"([0-9]+)$", 1).try_cast("bigint")


def digits_id(c: Column) -> Column:
    """All digits as a number; null where there are none."""
    return F.regexp_replace(c, r"[^0-9]", "").try_cast("bigint")


def clean_code(c: Column) -> Column:
    """Upper case without dots and outer blanks; null becomes empty."""
    return F.coalesce(F.regexp_replace(F.upper(F.trim(c)), r"\.", ""), F.lit(""))


# Code groups as exact codes, four-character and three-character prefixes.
CODE_GROUPS = {
    "congestive_heart_failure": (
        ["39891", "40201", "40211", "40291", "40401", "40403", "40411", "40413", "40491", "40493"],
        ["4254", "4255", "4257", "4258", "4259"],
        ["428"],
    ),
    "cardiac_arrhythmias": (
        ["42613", "42610", "42612", "99601", "99604"],
        ["4260", "4267", "4269", "4270", "4271", "4272", "4273", "4274", "4276", "4278", "4279", "7850", "V450", "V533"],
        [],
    ),
    "valvular_disease": ([], ["0932", "7463", "7464", "7465", "7466", "V422", "V433"], ["394", "395", "396", "397", "424"]),
    "peripheral_vascular_disease": (
        [],
        ["0930", "4373", "4431", "4432", "4438", "4439", "4471", "5571", "5579", "V434"],
        ["440", "441"],
    ),
    "hypertension": ([], [], ["401", "402", "403", "404", "405"]),
    "diabetes": ([], ["2500", "2501", "2502", "2503", "2504", "2505", "2506", "2507", "2508", "2509"], []),
    "renal_failure": (
        ["40301", "40311", "40391", "40402", "40403", "40412", "40413", "40492", "40493"],
        ["5880", "V420", "V451"],
        ["585", "586", "V56"],
    ),
    "chronic_pulmonary_disease": (
        [],
        ["4168", "4169", "5064", "5081", "5088"],
        ["490", "491", "492", "493", "494", "495", "496", "500", "501", "502", "503", "504", "505"],
    ),
}


def in_group(code: Column, group: tuple[list[str], list[str], list[str]]) -> Column:
    exact, four, three = group
    return code.isin(exact) | F.substring(code, 1, 4).isin(four) | F.substring(code, 1, 3).isin(three)


def record_time(name: Column) -> Column:
    """The time in names like ``p123-2001-02-03-04-05[-06]``; null where there is none or it is no date."""
    pattern = r"p?\d+-(\d{4})-(\d{2})-(\d{2})-(\d{2})-(\d{2})(?:-(\d{2}))?"
    parts = [F.regexp_extract(name, pattern, i) for i in range(1, 7)]
    seconds = F.when(parts[5] == "", F.lit("00")).otherwise(parts[5])
    text = F.concat(parts[0], F.lit("-"), parts[1], F.lit("-"), parts[2], F.lit(" "), parts[3], F.lit(":"), parts[4], F.lit(":"), seconds)
    return F.when(parts[0] != "", F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"))


def record_start(name: Column, path: Column) -> Column:
    """``record_time`` of a trimmed name, or of the last part of the path where the name is null or blank."""
    trimmed = F.regexp_replace(F.coalesce(name, F.lit("")), r"^\s+|\s+$", "")
    base = F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/]*)/*$", 1)
    return record_time(F.when(trimmed == "", base).otherwise(trimmed))


def seconds_between(start: Column, stop: Column) -> Column:
    """Seconds as a double, to the microsecond."""
    return F.timestamp_diff("MICROSECOND", start, stop) / F.lit(1e6)


def top_coded_age(age: Column, limit: float = 89.0, code: float = 90.0) -> Column:
    return F.when(age > limit, F.lit(code)).when(age >= 0, age)


def stable_fold(ident: Column, folds: int = 5, salt: str = FOLD_SALT) -> Column:
    """The first 16 hex digits of a salted SHA-256, modulo the number of folds."""
    head = F.substring(F.sha2(F.concat(F.lit(salt), ident.cast("string")).cast("binary"), 256), 1, 16)
    return (F.conv(head, 16, 10).cast("decimal(20,0)") % folds).cast("int")


def hash_order(ident: Column, replicate: Column, seed: int) -> Column:
    """A sortable digest that gives each replicate an order of its own."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), replicate.cast("string"), ident.cast("string")).cast("binary"), 256)


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


# Labels and limits of the decisions.
def delta_band(delta: Column, strong: float = 0.03, some: float = 0.01) -> Column:
    return F.when(delta >= strong, "MATERIAL_GE_0.03").when(delta >= some, "MODEST_0.01_TO_LT_0.03").otherwise("NO_MATERIAL_GAIN_LT_0.01")


def exposure_role(exposed: Column, unexposed: Column) -> Column:
    enough = unexposed >= 200
    main, extra = F.lit("MAIN_STAGE7C_CANDIDATE"), F.lit("EXPLORATORY_SUPPLEMENT_ONLY")
    return F.when((exposed >= 50) & enough, main).when((exposed >= 30) & enough, extra).otherwise("DESCRIPTIVE_PREVALENCE_ONLY")


def coverage_role(share: Column) -> Column:
    main, some = F.lit("AUTHORIZE_EXTENDED_CONSTITUTIONAL_MODEL"), F.lit("SECONDARY_COMPLETE_CASE_SENSITIVITY_ONLY")
    return F.when(share >= 0.8, main).when(share >= 0.6, some).otherwise("DESCRIPTIVE_AVAILABILITY_ONLY")


# Patterns that a release must not hold.
LEAKS = {
    "mac_path": r"/Users/[A-Za-z0-9_.-]+/",
    "home_path": r"/home/[A-Za-z0-9_.-]+/",
    "windows_path": r"[A-Za-z]:\\\\Users\\\\",
    "patient_id": r"(?i)\bp[0-9]{5,}\b",
    "hub_token": r"ghp_[A-Za-z0-9]{20,}",
    "hub_pat": r"github_pat_[A-Za-z0-9_]{20,}",
    "private_key": r"-----BEGIN (?:RSA |OPENSSH |EC )?PRIVATE KEY-----",
    "access_key": r"AKIA[0-9A-Z]{16}",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[a-z]{2,}",
    "phone": r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
    "token": r'token = "[0-9a-f]{32,}"',
    "license": r"[Ll]icen[sc]e",
}


def leak_counts(text: Column) -> dict[str, Column]:
    return {name: F.regexp_count(text, F.lit(pattern)).cast("long") for name, pattern in LEAKS.items()}


# Words of a path that tell what code is for, in the order of preference.
CODE_KINDS = {
    "publication": ["figure", "export", "render", "publication", "manuscript"],
    "audit": ["audit", "preflight", "freeze", "closeout", "serialize", "staging", "lock"],
}


def code_kind(path: Column) -> Column:
    """Publication, audit or scientific code, by words of its path."""
    low = F.lower(path)
    out = None
    for kind, words in CODE_KINDS.items():
        met = F.lit(False)
        for w in words:
            met = met | low.contains(w)
        out = F.when(met, kind) if out is None else out.when(met, kind)
    return out.otherwise("scientific")


def metric_value(text: Column, name: str) -> Column:
    """The number behind a name in a readout, over line ends, as in ``name ... = 1.5e-3``; null where there is none."""
    escaped = "".join(f"[{c}]" if not c.isalnum() and c not in " _" else c for c in name)
    return F.regexp_extract(text, rf"(?s){escaped}[^0-9+=:-]*[=:]\s*([+-]?[0-9]+(?:\.[0-9]*)?(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double")


def has_phrase(text: Column, phrase: str) -> Column:
    """Whether a phrase stands in the text, whatever white space parts its words; null counts as not."""
    flat = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.coalesce(F.contains(flat, F.lit(" ".join(phrase.lower().split()))), F.lit(False))


def window_start(record_start: Column, start_sample: Column, fs: Column) -> Column:
    """The moment of a sample, to the microsecond."""
    return F.timestamp_add("MICROSECOND", F.round(start_sample * F.lit(1e6) / fs).cast("long"), record_start)


def custom_order(value: Column, order: list[str]) -> Column:
    """The place of a value in a stated order; values that it lacks come last."""
    place = F.array_position(F.array(*(F.lit(o) for o in order)), value)
    return F.when(place > 0, place).otherwise(F.lit(len(order) + 1)).cast("int")


def flattened(column: str, names: list[str]) -> list[Column]:
    """Elements of a list as columns of their own, null beyond its end."""
    return [F.get(F.col(column), F.lit(i)).alias(n) for i, n in enumerate(names)]

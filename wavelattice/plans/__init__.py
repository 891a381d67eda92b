"""Queries over the driver tables, with their SQL."""

from . import core, geometry, release, shapes, stats

MODULES = (core, stats, geometry, shapes, release)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}

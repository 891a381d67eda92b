"""Vectors as ``array<double>`` columns: moments, normalised shapes, products, resampling."""

from __future__ import annotations

from math import cos, pi, sin, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

LENGTH = 64
TINY = 1e-12


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def _with(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def population_sd(v: Column) -> Column:
    return _with(mean(v), lambda m: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(v)))


def centred(v: Column) -> Column:
    return _with(mean(v), lambda m: F.transform(v, lambda x: x - m))


def is_finite(v: Column) -> Column:
    """No element is null, NaN or infinite."""
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def normalised(v: Column, length: int = LENGTH, tiny: float = TINY) -> Column:
    """Zero mean and unit population deviation; null for another length, a non-finite value or a deviation up to ``tiny``."""
    shape = _with(F.struct(mean(v).alias("m"), population_sd(v).alias("s")), lambda r: F.when(r.s > tiny, F.transform(v, lambda x: (x - r.m) / r.s)))
    return F.when((F.size(v) == length) & is_finite(v), shape)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def correlation(a: Column, b: Column, tiny: float = TINY) -> Column:
    """Pearson correlation; null where a centred norm is up to ``tiny``."""
    both = F.struct(centred(a).alias("a"), centred(b).alias("b"))
    return _with(both, lambda r: F.when((norm(r.a) > tiny) & (norm(r.b) > tiny), dot(r.a, r.b) / (norm(r.a) * norm(r.b))))


def resampled(v: Column, n: int = LENGTH) -> Column:
    """``v`` at ``n`` phases from its first to (excluding) its last sample, by linear interpolation."""

    def at(i: Column) -> Column:
        t = i * (F.size(v) - 1) / F.lit(float(n))
        k = F.floor(t).cast("int")
        return F.get(v, k) + (t - k) * (F.get(v, F.least(k + 1, F.size(v) - 1)) - F.get(v, k))

    return F.when(F.size(v) > 1, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at))


def unit_sum(v: Column) -> Column:
    """Negative elements at 0, scaled to sum to 1; null where nothing is left."""
    kept = F.transform(v, lambda x: F.greatest(x, F.lit(0.0)))
    return _with(kept, lambda k: F.when(total(k) > 0, F.transform(k, lambda x: x / total(k))))


def effective_support(v: Column) -> Column:
    """exp of the entropy of a distribution."""
    return F.exp(-F.aggregate(v, F.lit(0.0), lambda s, p: s + F.when(p > 0, p * F.ln(p)).otherwise(0.0)))


def differences(v: Column, order: int = 1) -> Column:
    """Forward differences; of order 2 the differences of those."""
    for _ in range(order):
        v = _differences(v)
    return v


def _differences(v: Column) -> Column:
    return F.zip_with(F.slice(v, 2, F.size(v) - 1), F.slice(v, 1, F.size(v) - 1), lambda after, before: after - before)


def largest(v: Column) -> Column:
    return F.array_max(v)


def peak_to_peak(v: Column) -> Column:
    return F.array_max(v) - F.array_min(v)


def sign_fixed(v: Column) -> Column:
    """``v`` or its negative, such that the (first) entry of largest size is positive."""
    top = F.array_position(F.transform(v, F.abs), F.array_max(F.transform(v, F.abs)))
    return F.when(F.element_at(v, top.cast("int")) < 0, F.transform(v, lambda x: -x)).otherwise(v)


def fourier_vector(k: int, kind: str, n: int = LENGTH) -> list[float]:
    """The ``k``-th cosine or sine over ``n`` phases, of unit length; for 0 < k < n/2 they are orthogonal and centred."""
    wave = cos if kind == "cos" else sin
    return [sqrt(2 / n) * wave(2 * pi * k * i / n) for i in range(n)]


def literal(values: list[float]) -> Column:
    return F.lit([float(x) for x in values])


def projected(v: Column, basis: list[list[float]]) -> list[Column]:
    """The coordinates of ``v`` along the rows of ``basis``."""
    return [dot(v, literal(b)) for b in basis]


def residual(v: Column, basis: list[list[float]]) -> Column:
    """``v`` without its components along orthonormal rows of ``basis``."""
    for b in basis:
        v = _without(v, literal(b))
    return v


def _without(v: Column, row: Column) -> Column:
    # ``v`` stands here once: used twice, it would double with every row that is taken out.
    return _with(v, lambda u: _with(dot(u, row), lambda z: F.zip_with(u, row, lambda x, b: x - z * b)))


def phase_grid(n: int = LENGTH, at: str = "left") -> Column:
    """Phases of ``n`` bins: their left ends, middles or right ends."""
    shift = {"left": 0.0, "middle": 0.5, "right": 1.0}[at]
    return F.array(*(F.lit((i + shift) / n) for i in range(n)))

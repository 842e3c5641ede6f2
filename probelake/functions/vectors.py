"""Expressions over arrays of doubles; they stay in the JVM. Null arrays and null elements give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(v: Column | str) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    """The dot product; the longer vector's surplus makes it null."""
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def norm(v: Column | str) -> Column:
    return F.sqrt(total(F.transform(_c(v), lambda x: x * x)))


def let(value: Column, f) -> Column:
    """f of the value, which is evaluated once a row: inside a lambda an expression would be evaluated for every element."""
    return F.transform(F.array(value), f)[0]


def normalised(v: Column | str) -> Column:
    """v of length 1; a vector of zeros stays."""
    return let(norm(v), lambda n: F.when(n == 0, _c(v)).otherwise(F.transform(_c(v), lambda x: x / n)))


def shifted(v: Column | str, by: Column | float, along: Column | str) -> Column:
    """v + by * along."""
    by = by if isinstance(by, Column) else F.lit(float(by))
    return let(by, lambda b: F.zip_with(_c(v), _c(along), lambda x, d: x + b * d))


def sigmoid(x: Column | str) -> Column:
    return 1.0 / (1.0 + F.exp(-_c(x)))


def softmax(v: Column | str) -> Column:
    e = let(F.array_max(_c(v)), lambda top: F.transform(_c(v), lambda x: F.exp(x - top)))
    return let(e, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def hellinger(p: Column | str, q: Column | str) -> Column:
    """The sum of (sqrt p - sqrt q) ** 2."""
    return total(F.zip_with(_c(p), _c(q), lambda x, y: (F.sqrt(x) - F.sqrt(y)) * (F.sqrt(x) - F.sqrt(y))))


def sanitized(x: Column | str, bound: float = 1e4) -> Column:
    """NaN as 0, everything else within [-bound, bound]."""
    x = _c(x)
    return F.when(F.isnan(x), 0.0).otherwise(F.greatest(F.lit(-bound), F.least(F.lit(bound), x)))


def sparsified(v: Column | str, k: int, absolute: bool = False) -> Column:
    """The k largest values (of their size, if absolute) in place, 0 elsewhere; ties at the edge all stay."""
    v = _c(v)
    size = (lambda x: F.abs(x)) if absolute else (lambda x: x)
    edge = F.element_at(F.sort_array(F.transform(v, size), asc=False), F.least(F.lit(k), F.size(v)))
    return let(edge, lambda e: F.transform(v, lambda x: F.when(size(x) >= e, x).otherwise(0.0)))


def selected(v: Column | str, kept: list[int]) -> Column:
    """v with 0 at every place not in kept (places from 0)."""
    places = F.array(*[F.lit(i) for i in kept]) if kept else F.array().cast("array<int>")
    return F.transform(_c(v), lambda x, i: F.when(F.array_contains(places, i), x).otherwise(0.0))


def padded(v: Column | str, length: int) -> Column:
    """v with zeros behind, up to length."""
    return F.concat(_c(v), F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(length) - F.size(_c(v)))))


def translated(v: Column | str, direction: Column | str, t: float, absolute: bool = True) -> Column:
    """v moved along the direction's unit vector by t, or, unless absolute, until its projection is t."""
    return let(normalised(direction), lambda d: shifted(v, F.lit(float(t)) if absolute else F.lit(float(t)) - dot(v, d), d))


def amplified(v: Column | str, direction: Column | str, s: float) -> Column:
    """v moved by s along the unit direction, to the side its projection has."""
    return let(normalised(direction), lambda d: shifted(v, F.signum(dot(v, d)) * s, d))


def polarized(v: Column | str, direction: Column | str, s: float, positive: bool = True) -> Column:
    """As amplified, but only vectors whose projection is positive (or negative) move."""
    step = lambda side: F.when(side > 0 if positive else side < 0, F.signum(side) * s).otherwise(0.0)
    return let(normalised(direction), lambda d: shifted(v, step(dot(v, d)), d))


def translated_raw(v: Column | str, direction: Column | str, t: float) -> Column:
    """v + t * direction, the direction as it is."""
    return shifted(v, t, direction)


def amplified_raw(v: Column | str, direction: Column | str, f: float) -> Column:
    """Each x + f * sign(d * x) * d."""
    return F.zip_with(_c(v), _c(direction), lambda x, d: x + f * F.signum(d * x) * d)

"""Column expressions over ``array<double>`` vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least norm, and least scale of a calibrated score.
NORM_EPS, SCALE_EPS = 1e-12, 1e-8


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row, also where lambdas use it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed in the order of the components."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """The vector over its length; a zero vector stays zero."""
    return bind(F.greatest(norm(v), F.lit(NORM_EPS)), lambda n: F.transform(v, lambda x: x / n))


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def clip01(x: Column) -> Column:
    """Clipped to [0, 1]; 0 where it is null, NaN or infinite."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def fold_sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def population_scale(xs: Column, factor: float = 1.0) -> Column:
    """Population standard deviation times ``factor``, clipped below after the product."""
    n = F.size(xs)
    var = bind(fold_sum(xs) / n, lambda m: F.aggregate(xs, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / n)
    return F.greatest(F.sqrt(var) * factor, F.lit(SCALE_EPS))


def logsumexp(xs: Column) -> Column:
    """Shifted by the maximum, so that large values do not overflow."""
    return bind(F.array_max(xs), lambda m: m + F.log(F.aggregate(xs, F.lit(0.0), lambda s, x: s + F.exp(x - m))))


def scaled_log_softmax(xs: Column, factor: float = 1.0) -> Column:
    """``x/s - logsumexp(x/s)`` for each x, with s the clipped population deviation of all."""
    scaled = lambda s: bind(F.transform(xs, lambda x: x / s), lambda ys: bind(logsumexp(ys), lambda z: F.transform(ys, lambda y: y - z)))
    return bind(population_scale(xs, factor), scaled)


def softmax(xs: Column, temperature: float) -> Column:
    weights = lambda ls: bind(F.array_max(ls), lambda m: F.transform(ls, lambda x: F.exp(x - m)))
    return bind(bind(F.transform(xs, lambda x: x / temperature), weights), lambda es: bind(fold_sum(es), lambda t: F.transform(es, lambda e: e / t)))


def argmax_first(xs: Column) -> Column:
    """Place (from 0) of the first greatest element."""
    return (F.array_position(xs, F.array_max(xs)) - 1).cast("long")

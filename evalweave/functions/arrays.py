"""Array kernels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gradient_variance(z: Column, v: Column) -> Column:
    """Population variance of the slopes between neighbours; null for fewer than two points."""
    g = F.transform(F.sequence(F.lit(0), F.size(v) - 2), lambda i: (F.get(v, i + 1) - F.get(v, i)).cast("double") / (F.get(z, i + 1) - F.get(z, i)).cast("double"))
    zero = F.lit(0.0)
    mean = F.aggregate(g, zero, lambda a, x: a + x) / F.size(g)
    square = F.aggregate(g, zero, lambda a, x: a + x * x) / F.size(g)
    return F.when(F.size(v) > 1, square - mean * mean)


def peak_normalise(v: Column) -> Column:
    """Divided by the largest absolute value; null where all are 0."""
    peak = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    return F.when(peak > 0, F.transform(v, lambda x: x.cast("double") / peak))


def centroid(f: Column, p: Column) -> Column:
    """Mean of f weighted by p; null where p sums to 0."""
    top = F.aggregate(F.zip_with(f, p, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return top / F.nullif(F.aggregate(p, F.lit(0.0), lambda a, x: a + x.cast("double")), F.lit(0.0))


def is_increasing(v: Column) -> Column:
    """Whether each element is above the one before it; true for fewer than two, null for null."""
    return F.when(F.size(v) < 2, F.lit(True)).otherwise(F.forall(F.sequence(F.lit(1), F.size(v) - 1), lambda i: F.get(v, i) > F.get(v, i - 1)))


def decibels(p: Column, floor: float) -> Column:
    """Power in decibels, no lower than floor."""
    return 10 * F.log10(F.greatest(p, F.lit(10 ** (floor / 10))))


def strongest_with_first(v: Column, k: int) -> Column:
    """Indexes of the k largest absolute values, ascending; the first element has the last slot if it isn't among them. Ties: the earlier."""
    at = F.transform(v, lambda x, i: F.struct((-F.abs(x)).alias("a"), i.alias("i")))
    top = F.slice(F.transform(F.array_sort(at), lambda z: z["i"]), 1, k)
    return F.array_sort(F.when(F.array_contains(top, 0), top).otherwise(F.array_append(F.slice(top, 1, k - 1), F.lit(0))))

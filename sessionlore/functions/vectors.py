"""Similarity of vectors."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda t, x: t + x)


def wide(v: Column) -> Column:
    return v.cast("array<double>")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(wide(v), F.lit(0.0), lambda t, x: t + x * x))


def cosine(a: Column, b: Column, norms: tuple[Column, Column] | None = None) -> Column:
    """Cosine in double precision. An empty side or a zero vector gives 0; of
    unequal lengths the product covers the shorter, the norms all. ``norms``
    are those of both where they are known."""
    a, b = wide(a), wide(b)
    product = _sum(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))))
    size = norms or (norm(a), norm(b))
    usable = (size[0] != 0) & (size[1] != 0)
    return F.coalesce(F.when(usable, product / (size[0] * size[1])), F.lit(0.0))

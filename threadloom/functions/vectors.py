"""Expressions on dense vectors held as array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalise(v: Column) -> Column:
    """Unit vector in double precision; a zero vector stays as it is.

    The length is paired with the cells rather than captured by the function, so
    that it is computed once per vector.
    """
    lengths = F.array_repeat(norm(v), F.size(v))
    return F.zip_with(v, lengths, lambda x, n: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))

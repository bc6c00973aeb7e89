"""Vector arithmetic on arrays, in double precision inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product; arrays of unlike length or with nulls give null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Divided by its length; a zero vector stays zero."""
    size = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(size > 0, size).otherwise(1.0))

"""Vector expressions on array columns, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.arrays import bind
from corpusloom.functions.text import _col


def as_double(v: Column | str) -> Column:
    return _col(v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(
        F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def normalize(v: Column | str) -> Column:
    """Unit vector; a zero vector stays as it is."""
    return bind(
        as_double(v),
        lambda d: bind(
            norm(d), lambda n: F.when(n == 0, d).otherwise(F.transform(d, lambda x: x / n))
        ),
    )


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity, null when either side is a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))

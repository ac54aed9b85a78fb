"""Arithmetic on vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays zero."""
    bound = F.array(F.struct(a.alias("v"), norm(a).alias("n")))
    return F.transform(bound, lambda x: F.when(x["n"] == 0, x["v"].cast("array<double>")).otherwise(F.transform(x["v"], lambda y: y.cast("double") / x["n"])))[0]


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))

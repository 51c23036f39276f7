"""Dense-vector column expressions (array<float|double> columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")),
                              F.lit(0.0).cast("double"), lambda acc, x: acc + x))


def cosine(a: Column, b: Column, na: Column | None = None, nb: Column | None = None) -> Column:
    """Cosine similarity; NULL when either vector has zero norm."""
    na = norm(a) if na is None else na
    nb = norm(b) if nb is None else nb
    return F.try_divide(dot(a, b), F.nullif(na * nb, F.lit(0.0)))


def sigmoid(x: Column) -> Column:
    """Two-logit softmax, class 1 == sigmoid of the logit difference."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))

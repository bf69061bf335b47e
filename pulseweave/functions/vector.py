"""Dense vector columns (``array<double>``)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def norm(a: Column) -> Column:
    return F.sqrt(
        F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null where either has no length."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale)


def usable(a: Column) -> Column:
    """A vector that can be clustered: not null, not empty, not all zeros."""
    return a.isNotNull() & (F.size(a) > 0) & (norm(a) > 0)


def scale(a: Column, by: Column) -> Column:
    return F.transform(a, lambda v: v * by)


def sum_vector(vector: Column) -> Column:
    """Aggregate: sum of vectors of any one width, as one buffer and not one per dimension."""
    return vector_to_array(Summarizer.sum(array_to_vector(vector)))


def mean_vector(vector: Column) -> Column:
    """Aggregate: mean of vectors, like ``sum_vector``."""
    return vector_to_array(Summarizer.mean(array_to_vector(vector)))

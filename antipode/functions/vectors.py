"""Columns over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_norm(a: Column) -> Column:
    return dot(a, a)


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is 0."""
    return F.try_divide(F.try_divide(dot(a, b), F.sqrt(squared_norm(a))), F.sqrt(squared_norm(b)))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def axpy(a: Column, by: Column, b: Column) -> Column:
    """a + by * b"""
    return F.zip_with(a, b, lambda x, y: x + by * y)


def similarity(a: Column, bias_a: Column, b: Column, bias_b: Column) -> Column:
    """The mean of the two directions' scores."""
    d = dot(a, b)
    return F.lit(0.5) * (sigmoid(d + bias_a) + sigmoid(d + bias_b))


def cost_term(q: Column, pos: Column, neg: Column) -> Column:
    """Log-likelihood of an update, 0 where q has run to 0 or 1."""
    safe = (q > 0) & (q < 1)
    kept = F.when(safe, q)
    return F.coalesce(-(pos * F.log(kept) + neg * F.log(F.lit(1.0) - kept)), F.lit(0.0))


def sum_vectors(vector: str, dim: int) -> Column:
    """Aggregate: the sum of a vector column, one partial sum a dimension, so nothing is exploded."""
    return F.array(*(F.coalesce(F.sum(F.get(F.col(vector), F.lit(i))), F.lit(0.0)) for i in range(dim)))


def mean_vectors(vector: str, dim: int) -> Column:
    return F.array(*(F.avg(F.get(F.col(vector), F.lit(i))) for i in range(dim)))

"""Small-vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimals kept when distances are compared, so that summation order cannot break a tie.
DISTANCE_DECIMALS = 9


def squared_distance(a: Column, b: Column) -> Column:
    """Squared euclidean distance of ``a`` and the prefix of ``b`` of the same length."""
    terms = F.zip_with(a, F.slice(b, F.lit(1), F.size(a)), lambda x, y: (x - y) * (x - y))
    return F.aggregate(terms, F.lit(0.0), lambda total, term: total + term)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def nonzero_count(vector: Column) -> Column:
    return F.size(F.filter(vector, lambda x: x != 0))


def vector_sum(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda total, x: total + x)


def nearest(vector: Column, candidates: Column) -> Column:
    """Label of the closest candidate, the lowest rank winning a tie.

    ``candidates`` is an array of ``struct<rank, label, center>``. The search runs inside
    the row: no candidate is ever paired with a row through a join.
    """
    scored = F.transform(
        candidates,
        lambda c: F.struct(
            F.round(squared_distance(vector, c["center"]), DISTANCE_DECIMALS).alias("distance"),
            c["rank"].alias("rank"),
            c["label"].alias("label"),
        ),
    )
    return F.array_min(scored)["label"]

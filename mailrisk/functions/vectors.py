"""Similarity of dense vectors held as arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailrisk.functions.text import ColumnLike, _col


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A column used inside a lambda is computed again for every element; bound
    this way a vector's length costs O(d) instead of O(d * d).
    """
    return F.transform(F.array(value), body)[0]


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: ColumnLike, b: ColumnLike) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: ColumnLike) -> Column:
    return F.sqrt(total(F.transform(_col(a), lambda x: x.cast("double") * x.cast("double"))))


def unit(a: ColumnLike) -> Column:
    """Vector of length one; a zero vector stays zero."""
    x = _col(a)
    length = norm(x)
    scale = F.when(length == 0, F.lit(1.0)).otherwise(length)
    return let(scale, lambda s: F.transform(x, lambda v: v.cast("double") / s))


def cosine_similarity(a: ColumnLike, b: ColumnLike) -> Column:
    """a.b / (|a||b|); 0 when either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def cosine_distance(a: ColumnLike, b: ColumnLike) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def closer_set(sim_a: ColumnLike, sim_b: ColumnLike, name_a: str, name_b: str) -> Column:
    """Name of the more similar set; the second on a tie."""
    return F.when(_col(sim_a) > _col(sim_b), name_a).otherwise(name_b)

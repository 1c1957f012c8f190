"""Distances and norms of vectors (arrays of floats) as Columns, in double precision."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_DIMENSIONS = 16_000


def literal(values: Sequence[float]) -> Column:
    """A vector literal. It must have 1 to ``MOST_DIMENSIONS`` finite elements."""
    checked = [float(x) for x in values]
    if not 1 <= len(checked) <= MOST_DIMENSIONS:
        raise ValueError(f"a vector has 1 to {MOST_DIMENSIONS} dimensions, not {len(checked)}")
    if not all(map(math.isfinite, checked)):
        raise ValueError("the elements of a vector must be finite")
    return F.array(*map(F.lit, checked))


def same_dimension(a: Column, b: Column) -> Column:
    """``a``, or an error where ``b`` has another dimension."""
    return F.when(F.size(a) == F.size(b), a).when(a.isNull() | b.isNull(), F.lit(None)).otherwise(F.raise_error(F.lit("different vector dimensions")))


def valid(a: Column, dim: int | None = None) -> Column:
    """Whether a vector has 1 to ``MOST_DIMENSIONS`` finite elements (exactly ``dim`` where given) and none of them is NULL."""
    size = F.size(a) == dim if dim else F.size(a).between(1, MOST_DIMENSIONS)
    return F.coalesce(size & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def inner_product(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_squared(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def l1(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def negative_inner_product(a: Column, b: Column) -> Column:
    return -inner_product(a, b)


def norm(a: Column) -> Column:
    return F.sqrt(inner_product(a, a))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine, the cosine held within -1 and 1; 1 where either norm is 0."""
    squares = inner_product(a, a) * inner_product(b, b)
    return F.when(squares == 0, F.lit(1.0)).otherwise(1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), inner_product(a, b) / F.sqrt(squares))))


def normalise(a: Column) -> Column:
    """The unit vector as floats; a zero vector stays."""
    length = norm(a)
    return F.when(length == 0, a).otherwise(F.transform(a, lambda x: (x.cast("double") / length).cast("float")))


#: By metric: the distance that ranks (squared for L2) and the one that is shown.
RANKING = {"cosine": cosine, "l2": l2_squared, "ip": negative_inner_product, "l1": l1}
SHOWN = {"cosine": cosine, "l2": l2, "ip": negative_inner_product, "l1": l1}

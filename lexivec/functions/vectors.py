"""Vector functions as column expressions over numeric arrays."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# (element, index, side) -> number, where side is 0 for the first vector and 1 for the second.
Accessor = Callable[[Column, Column, int], Column]

UNROLL_LIMIT = 1024


def _values(x: Column, accessor: Accessor | None, side: int) -> Column:
    if accessor is None:
        return F.transform(x, lambda v: v.cast("double"))
    return F.transform(x, lambda v, i: accessor(v, i, side).cast("double"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times inside a lambda expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _dot_values(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def _norm_values(a: Column) -> Column:
    def scaled(largest: Column) -> Column:
        squares = F.aggregate(a, F.lit(0.0), lambda s, v: s + (v / largest) * (v / largest))
        return F.when(largest == 0.0, F.lit(0.0)).otherwise(largest * F.sqrt(squares))

    return _let(F.array_max(F.transform(a, lambda v: F.abs(v))), scaled)


def _same_length(x: Column, y: Column, value: Column, name: str) -> Column:
    error = F.raise_error(F.lit(f"{name}: vectors must have equal length")).cast("double")
    return F.when(F.size(x) != F.size(y), error).when(F.size(x) == 0, F.lit(None).cast("double")).otherwise(value)


def dot(x: Column, y: Column, accessor: Accessor | None = None) -> Column:
    """Dot product; an error on unequal length, null for empty vectors."""
    return _same_length(x, y, _dot_values(_values(x, accessor, 0), _values(y, accessor, 1)), "dot")


def l2norm(x: Column, accessor: Callable[[Column, Column], Column] | None = None) -> Column:
    """Euclidean norm, scaled by the largest component so that squares cannot overflow; null when empty."""
    values = _values(x, None if accessor is None else lambda v, i, _: accessor(v, i), 0)
    return F.when(F.size(x) == 0, F.lit(None).cast("double")).otherwise(_norm_values(values))


def cosine(x: Column, y: Column, accessor: Accessor | None = None) -> Column:
    """Cosine similarity; an error on unequal length, null when empty, NaN with a zero vector."""
    a, b = _values(x, accessor, 0), _values(y, accessor, 1)

    def ratio(parts: Column) -> Column:
        product, norms = parts["product"], parts["norms"]
        no_ratio = F.when(product == 0.0, F.lit(float("nan"))).otherwise(F.signum(product) * F.lit(float("inf")))
        return F.when(norms == 0.0, no_ratio).otherwise(product / norms)

    parts = F.struct(_dot_values(a, b).alias("product"), (_norm_values(a) * _norm_values(b)).alias("norms"))
    return _same_length(x, y, _let(parts, ratio), "cosine")


def dot_literal(x: Column, vector: Sequence[float]) -> Column:
    """Dot product with one known vector.

    The sum is written out term by term, so it stays inside generated code; very
    long vectors use the array form.
    """
    vector = [float(v) for v in vector]
    if len(vector) > UNROLL_LIMIT:
        return dot(x, F.array(*[F.lit(v) for v in vector]))
    if not vector:
        return F.when(F.size(x) == 0, F.lit(0.0)).otherwise(F.raise_error(F.lit("dot: vectors must have equal length")))
    terms = [F.get(x, F.lit(i)).cast("double") * F.lit(v) for i, v in enumerate(vector)]
    error = F.raise_error(F.lit("dot: vectors must have equal length")).cast("double")
    return F.when(F.size(x) != len(vector), error).otherwise(reduce(lambda s, t: s + t, terms))

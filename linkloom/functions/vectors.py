"""Column functions on vectors (arrays of numbers) and sparse vectors (maps or arrays of index, value)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision, in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero; an error where lengths differ."""
    n = norm(a) * norm(b)
    value = F.when(n == 0, 0.0).otherwise(dot(a, b) / n)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length"))).otherwise(value)


def l2_normalize(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))


def mean_pool(states: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is not 0, then L2-normalised; zeros if there is none."""
    kept = F.transform(F.filter(F.arrays_zip(states.alias("v"), mask.alias("m")), lambda x: x["m"] != 0), lambda x: x["v"])
    n = F.size(kept)
    dims = F.size(F.get(states, F.lit(0)))
    total = F.aggregate(kept, F.array_repeat(F.lit(0.0), dims), lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return l2_normalize(F.transform(total, lambda x: F.when(n == 0, 0.0).otherwise(x / n)))


def sparse_dot(a: Column, b: Column) -> Column:
    """Dot product of arrays of (idx, value); an index appears once on each side."""
    right = F.map_from_entries(F.transform(b, lambda x: F.struct(x["idx"], x["value"].cast("double"))))
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x["value"].cast("double") * F.coalesce(F.try_element_at(right, x["idx"]), F.lit(0.0)))


def sparse_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x["value"].cast("double") * x["value"].cast("double")))


def sparse_cosine(a: Column, b: Column) -> Column:
    n = sparse_norm(a) * sparse_norm(b)
    return F.when(n == 0, 0.0).otherwise(sparse_dot(a, b) / n)

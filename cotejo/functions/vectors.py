"""Vector functions on array columns, in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """In [-1, 1]; null where a norm is zero or the lengths differ."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm(a) * norm(b)))


def euclidean(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    length = norm(a)
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), length))


def fused(semantic: Column, style: Column | None = None) -> Column:
    """A unit semantic vector with the style probability behind it; references have 0 there."""
    last = F.lit(0.0) if style is None else style.cast("double")
    return F.concat(unit(semantic), F.array(last))


def fused_cosine(semantic: Column, probability: Column) -> Column:
    """Cosine of a fused submission and a fused reference, from their semantic cosine.

    The style part only lengthens the submission's unit vector.
    """
    return semantic / F.sqrt(1 + probability.cast("double") * probability.cast("double"))


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length, in characters; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.coalesce(1 - F.try_divide(F.levenshtein(a, b).cast("double"), longer.cast("double")), F.when(longer == 0, F.lit(1.0)))

"""Copies of programs by type, and equal contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.functions.text import normalized, normalized_layout

#: From here on token sets are those of a changed copy, and vectors those of the same logic.
CHANGED, SAME_LOGIC = 0.6, 0.8


def equal_contents(code: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, hash, n and first: how many rows share a row's content, and the least key of them."""
    hashed = code.select(key, F.sha2(F.coalesce(text, F.lit("")), 256).alias("hash"))
    groups = hashed.groupBy("hash").agg(F.count("*").alias("n"), F.min(key).alias("first"))
    return hashed.join(groups, "hash").select(key, "hash", "n", "first")


def clone_classes(code: DataFrame, key: str, text: str = "contenido") -> DataFrame:
    """For each program the least key of its class of type I (layout) and type II (names as well)."""
    hashed = code.select(key, F.sha2(normalized_layout(F.col(text)), 256).alias("h1"), F.sha2(normalized(F.col(text)), 256).alias("h2"))
    one = hashed.groupBy("h1").agg(F.min(key).alias("type_1"))
    two = hashed.groupBy("h2").agg(F.min(key).alias("type_2"))
    return hashed.join(one, "h1").join(two, "h2").select(key, "type_1", "type_2")


def clone_type(a: Column, b: Column, jaccard: Column, cosine: Column) -> Column:
    """The type of a pair of programs, the strictest that fits: I to IV, null for none.

    I: equal but for layout and comments; II: but for names as well; III: token sets alike,
    with statements added or taken away; IV: alike in their semantic vectors only.
    """
    return (
        F.when(normalized_layout(a) == normalized_layout(b), "I")
        .when(normalized(a) == normalized(b), "II")
        .when(jaccard >= CHANGED, "III")
        .when(cosine >= SAME_LOGIC, "IV")
    )

"""Metrics of a classifier, agreement with people, corpus splits and balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion_matrix(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def classification_metrics(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row; a ratio without cases is null, rows with a null are not counted."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    counts = rows.filter(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn")
    )
    ratio = lambda a, b: F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.select(
        "tp",
        "fp",
        "tn",
        "fn",
        ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(fp, fp + tn).alias("false_positive_rate"),
    )


def correlations(rows: DataFrame, a: str, b: str, group: str) -> DataFrame:
    """Pearson and Spearman correlation of two columns in each group; null where a column is constant in it."""
    both = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull())

    def rank(c: str) -> Column:
        tied = F.count("*").over(Window.partitionBy(group, c))
        return F.rank().over(Window.partitionBy(group).orderBy(c)) + (tied - 1) / 2

    ranked = both.withColumns({"_a": rank(a), "_b": rank(b)})

    def correlation(x: str, y: str) -> Column:
        return F.round(F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)), 6)

    return ranked.groupBy(group).agg(F.count("*").alias("n"), correlation(a, b).alias("pearson"), correlation("_a", "_b").alias("spearman"))


def bucket_of(key: Column, buckets: int = 100) -> Column:
    """A fixed bucket of a key, alike on every engine that knows MD5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % buckets


def group_split(rows: DataFrame, group: str, train: int = 70, validation: int = 15) -> DataFrame:
    """``rows`` with ``split``; all rows of a group go together, so nothing leaks."""
    b = bucket_of(F.col(group))
    return rows.withColumn("split", F.when(b < train, "train").when(b < train + validation, "validation").otherwise("test"))


def balanced(rows: DataFrame, label: str, key: str) -> DataFrame:
    """As many rows of each class as the smallest has: those whose keys hash lowest.

    Each class is cut by a threshold on the hash first, so that only rows about the cut are ranked
    in one task of its class.
    """
    h = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    hashed = rows.filter(F.col(label).isNotNull()).withColumn("_h", h).withColumn("_bucket", F.shiftright("_h", 22))
    per_bucket = hashed.groupBy(label, "_bucket").agg(F.count("*").alias("_n"))
    so_far = Window.partitionBy(label).orderBy("_bucket")
    sums = per_bucket.withColumn("_upto", F.sum("_n").over(so_far))
    least = per_bucket.groupBy(label).agg(F.sum("_n").alias("_size")).agg(F.min("_size").alias("_least"))
    sums = sums.crossJoin(F.broadcast(least))  # one row
    edge = sums.select(F.col(label).alias("_label"), F.col("_bucket").alias("_b"), (F.col("_upto") - F.col("_n")).alias("_before"), "_upto", "_least")
    joined = hashed.join(F.broadcast(edge), (F.col(label) == F.col("_label")) & (F.col("_bucket") == F.col("_b")))  # at most 1024 rows a class
    whole = joined.filter("_upto <= _least").select(rows.columns)
    cut = joined.filter("_upto > _least and _before < _least")
    place = F.row_number().over(Window.partitionBy(label).orderBy("_h", key))
    return whole.unionByName(cut.withColumn("_place", place).filter("_place <= _least - _before").select(rows.columns))


def class_counts(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(label).agg(F.count("*").alias("n"))

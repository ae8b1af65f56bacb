"""Choice of a threshold: a histogram of scores, its curve and area, and the lowest threshold with few enough false alarms.

Scores fall into buckets of equal width. What lies above a bucket is a prefix sum over the buckets, of which there are few; what
lies above a score within its bucket is a window of that bucket, so buckets are ordered side by side. Scores that are
equal are one row from the start. All counts are whole numbers: no result depends on the number of buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotejo.sources.scratch import kept

BUCKETS = 1000


def _bucket(score: Column, low: float, high: float, buckets: int) -> Column:
    return F.greatest(F.least(F.floor((score - low) / (high - low) * buckets), F.lit(buckets - 1)), F.lit(0)).cast("int")


def score_counts(rows: DataFrame, score: str, truth: str, low: float = 0.0, high: float = 1.0, buckets: int = BUCKETS) -> DataFrame:
    """cubo, umbral, p and n: of each different score how many rows are true and how many are not. Rows with a null or NaN are not counted."""
    if buckets < 1 or not low < high:
        raise ValueError("buckets must be 1 or more, and low below high")
    held = rows.select(F.col(score).cast("double").alias("umbral"), (F.col(truth) == 1).alias("t")).filter(F.col("umbral").isNotNull() & ~F.isnan("umbral") & F.col("t").isNotNull())
    counted = held.groupBy("umbral").agg(F.count_if("t").alias("p"), F.count_if(~F.col("t")).alias("n"))
    # read several times from here on
    return kept(counted.withColumn("cubo", _bucket(F.col("umbral"), low, high, buckets)), "score-counts")


def histogram(counts: DataFrame) -> DataFrame:
    """cubo, p, n and what lies in the buckets above: p_above, n_above; and the totals p_all, n_all. At most as many rows as there are buckets."""
    per_bucket = counts.groupBy("cubo").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    above = Window.orderBy(F.desc("cubo")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("cubo")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = [F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in "pn"] + [F.sum(c).over(whole).alias(f"{c}_all") for c in "pn"]
    return per_bucket.select("cubo", "p", "n", *sums)


def curve(counts: DataFrame) -> DataFrame:
    """umbral, tp, fp, sensibilidad and falsas: for each different score what is called true from it on."""
    sums = histogram(counts).select("cubo", "p_above", "n_above", "p_all", "n_all")
    inside = Window.partitionBy("cubo").orderBy(F.desc("umbral"))
    joined = counts.join(F.broadcast(sums), "cubo")  # one row for each bucket
    reached = joined.select("umbral", "p", "n", "p_all", "n_all", *[(F.col(f"{c}_above") + F.sum(c).over(inside)).alias(f"{c}_from") for c in "pn"])
    ratio = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), 6)
    return reached.select("umbral", F.col("p_from").alias("tp"), F.col("n_from").alias("fp"), "p", "n", "p_all", "n_all", ratio("p_from", "p_all").alias("sensibilidad"), ratio("n_from", "n_all").alias("falsas"))


def area(points: DataFrame) -> DataFrame:
    """One row, area: the chance that a true row has a higher score than another, equal scores counted half; null without rows of both kinds."""
    # twice the pairs in whole numbers: a true row beats the others that lie below its score
    twice = F.sum((F.col("p") * (2 * (F.col("n_all") - F.col("fp")) + F.col("n"))).cast("decimal(38,0)"))
    pairs = F.max((F.col("p_all") * F.col("n_all") * 2).cast("decimal(38,0)"))
    return points.agg(F.round(F.try_divide(twice.cast("double"), F.nullif(pairs.cast("double"), F.lit(0.0))), 6).alias("area"))


def lowest_threshold(counts: DataFrame, below: float = 0.1) -> DataFrame:
    """One row: the lowest score from which on the share of false alarms is less than ``below``, with that share and the sensitivity; none if no score has it.

    The histogram tells the one bucket in which the share crosses the limit; only that bucket's scores are ordered.
    """
    sums = histogram(counts)
    few = lambda n: F.try_divide(n.cast("double"), F.col("n_all").cast("double")) < below
    # whole buckets that may be called true, and the first one below them, of which perhaps a part may
    cut = sums.filter(few(F.col("n_above"))).agg(F.min("cubo").alias("edge"), F.max("cubo").alias("top")).filter("edge is not null")
    near = counts.join(F.broadcast(sums.select("cubo", "p_above", "n_above", "p_all", "n_all")), "cubo")
    inside = near.join(F.broadcast(cut), F.col("cubo") == F.col("edge"))
    order = Window.orderBy(F.desc("umbral"))
    placed = inside.select("umbral", "p_all", "n_all", *[(F.col(f"{c}_above") + F.sum(c).over(order)).alias(f"{c}_from") for c in "pn"])
    here = placed.filter(few(F.col("n_from")))
    # where even the first score of that bucket is too much, the lowest score above it
    above = near.join(F.broadcast(cut), F.col("cubo") > F.col("edge")).groupBy("cubo").agg(F.min("umbral").alias("umbral"), *[F.first(c).alias(c) for c in ("p_above", "n_above", "p_all", "n_all")], F.sum("p").alias("p"), F.sum("n").alias("n"))
    both = here.unionByName(above.select("umbral", "p_all", "n_all", (F.col("p_above") + F.col("p")).alias("p_from"), (F.col("n_above") + F.col("n")).alias("n_from")))
    one = both.agg(F.min(F.struct("umbral", "p_from", "n_from", "p_all", "n_all")).alias("x")).filter("x is not null").select("x.*")
    ratio = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), 6)
    return one.select("umbral", F.col("p_from").alias("tp"), F.col("n_from").alias("fp"), ratio("p_from", "p_all").alias("sensibilidad"), ratio("n_from", "n_all").alias("falsas"))

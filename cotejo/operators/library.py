"""The library of references: search, pages and comparison lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cotejo.functions.bands import PAGE_SIZE, page_label, risk_band


def search(cards: DataFrame, term: str, columns: tuple[str, ...] = ("title", "description", "category")) -> DataFrame:
    """Cards that hold the term, as it is and in any case, in one of the columns; an empty term finds all."""
    if not term:
        return cards
    wanted = F.lower(F.lit(term))
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), wanted), F.lit(False))
    return cards.filter(hit)


def page(cards: DataFrame, number: int, order: str = "id", size: int = PAGE_SIZE) -> DataFrame:
    """One page of cards in order; pages begin with 1."""
    return cards.orderBy(order).offset((number - 1) * size).limit(size)


def page_count(cards: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    total = cards.agg(F.count("*").alias("total"))
    return total.select("total", F.ceil(F.col("total") / size).cast("long").alias("paginas"), page_label(F.lit(1), F.col("total")).alias("rango"))


def comparisons(reports: DataFrame, problem: str, score: str, most: int | None = None) -> DataFrame:
    """Per problem: how many comparisons there are, the best score, and how many are at each risk.

    With ``most`` the list of the best ones, at most so many, is added.
    """
    percent = F.round(100 * F.col(score), 4)
    risk = risk_band(percent)
    aggs = [F.count("*").alias("activas"), F.max(percent).alias("mayor"), *[F.count_if(risk == r).alias(r.lower()) for r in ("ALTO", "MEDIO", "BAJO")]]
    counted = reports.groupBy(problem).agg(*aggs)
    if most is None:
        return counted
    place = F.row_number().over(Window.partitionBy(problem).orderBy(F.desc(score), "id"))
    best = reports.withColumn("_place", place).filter(F.col("_place") <= most).groupBy(problem)
    lists = best.agg(F.array_sort(F.collect_list(F.struct("_place", "id", score))).alias("lista"))
    return counted.join(lists, problem)


def sample_cards(cards: DataFrame, n: int = 25) -> DataFrame:
    """``n`` cards that repeat the given ones in turn, each title with its number."""
    numbered = cards.selectExpr("row_number() over (order by id) - 1 as k", "*")  # a handful of cards
    turns = cards.sparkSession.range(n).crossJoin(F.broadcast(cards.agg(F.count("*").alias("m"))))
    ids = turns.select((F.col("id") + 1).alias("nuevo"), (F.col("id") % F.col("m")).alias("k"))
    joined = ids.join(F.broadcast(numbered), "k")
    return joined.withColumn("title", F.concat("title", F.lit(" #"), F.col("nuevo").cast("string"))).withColumn("id", F.col("nuevo").cast("int")).select(cards.columns)

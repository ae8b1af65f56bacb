"""Coverage of problems by generated references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.sources.schemas import KEY


def reference_counts(references: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """For each problem ``total`` and ``modelos``, a map of counts by model."""
    per_model = references.groupBy(*keys, "modelo").agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("modelo", "n")))  # as many as there are models
    return per_model.groupBy(*keys).agg(F.sum("n").alias("total"), F.map_from_entries(entries).alias("modelos"))


def by_problem(problems: DataFrame, references: DataFrame) -> DataFrame:
    """Every problem with the references it has, 0 and an empty map where it has none."""
    joined = problems.join(reference_counts(references), KEY, "left")
    return joined.select(
        *KEY,
        "num_archivos",
        F.coalesce("total", F.lit(0)).cast("long").alias("total"),
        F.coalesce("modelos", F.expr("cast(map() as map<string, bigint>)")).alias("modelos"),
    )


def export_rows(problems: DataFrame, references: DataFrame) -> DataFrame:
    """The columns of the coverage file."""
    return by_problem(problems, references).select(*KEY, F.col("num_archivos").alias("archivos_originales"), F.col("total").alias("referencias_ia"))


def by_group(problems: DataFrame, references: DataFrame) -> DataFrame:
    """Problems and references of each course and assignment that has either; one shuffle."""
    group = F.concat_ws("/", "curso", "carpeta").alias("grupo")
    both = problems.select(group, F.lit(1).alias("p"), F.lit(0).alias("r")).unionByName(references.select(group, F.lit(0).alias("p"), F.lit(1).alias("r")))
    return both.groupBy("grupo").agg(F.sum("p").alias("problemas"), F.sum("r").alias("referencias"))


def totals(problems: DataFrame, references: DataFrame) -> DataFrame:
    """One row: problems, references of any problem, and those of problems that aren't in the corpus."""
    counts = references.groupBy(*KEY).agg(F.count("*").alias("n"))
    orphans = counts.join(problems.select(*KEY), KEY, "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("referencias_huerfanas"))
    everything = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_referencias"))
    return problems.agg(F.count("*").alias("total_problemas")).crossJoin(everything).crossJoin(orphans)  # one row each


def nested_document(problems: DataFrame, references: DataFrame) -> DataFrame:
    """One row with the nested coverage document; only for reports, it holds a row for each problem."""
    rows = by_problem(problems, references)
    key = F.concat_ws("/", *KEY)
    listed = F.struct(*KEY, "num_archivos")
    covered = F.when(F.col("total") > 0, F.struct(key.alias("problema"), F.col("total"), F.col("modelos")))
    lists = rows.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(listed)).alias("problemas"), F.collect_list(covered).alias("por_problema"))
    by_key = F.array_sort("por_problema", lambda a, b: F.when(a["problema"] < b["problema"], -1).when(a["problema"] > b["problema"], 1).otherwise(0))
    return lists.crossJoin(totals(problems, references)).select(
        F.struct(F.col("n").alias("total_problemas"), "problemas").alias("dataset"),
        F.struct(F.col("total_referencias").alias("total"), by_key.alias("por_problema")).alias("referencias"),
    )


def references_by_model(references: DataFrame) -> DataFrame:
    return references.groupBy("modelo").agg(F.count("*").alias("n"), F.count_distinct(*KEY).alias("problemas"))


def pending(problems: DataFrame, *done: DataFrame) -> DataFrame:
    """Problems in none of the tables ``done``."""
    for table in done:
        problems = problems.join(table.select(*KEY), KEY, "left_anti")
    return problems


def eligible(statements: DataFrame, problems: DataFrame) -> DataFrame:
    """Statements whose problem is in the corpus and has code."""
    return statements.join(problems.filter("num_archivos > 0").select(*KEY), KEY, "left_semi")

"""Tables of a data folder, and how they stand in for the engine's own ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts cost time to read: one with fewer splits than there are cores is dealt out to all of them.

    Such a table is small. A larger one is left where it lies, and nothing is shuffled.
    """
    found, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return found.repartition(cores) if found.rdd.getNumPartitions() < cores else found


def everyone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a problem: region / nation / customer."""
    nation = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    customer = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return customer.select(F.col("r_name").alias("curso"), F.col("n_name").alias("carpeta"), F.col("c_name").alias("subcarpeta"), "c_custkey", "c_acctbal")


def problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus: customers in credit; their orders that are open are its files."""
    files = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    joined = everyone(spark, sf_dir).filter("c_acctbal >= 0").join(files, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("curso", "carpeta", "subcarpeta", F.coalesce("n", F.lit(0)).alias("num_archivos"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated references: partly filled orders of any customer; the priority is the model."""
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'")
    joined = orders.join(everyone(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("curso", "carpeta", "subcarpeta", F.lit(1).alias("version"), F.col("o_orderpriority").alias("modelo"))


SQL = """
WITH everyone AS (SELECT r_name AS curso, n_name AS carpeta, c_name AS subcarpeta, c_custkey, c_acctbal
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
problems AS (SELECT curso, carpeta, subcarpeta, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS num_archivos
  FROM everyone WHERE c_acctbal >= 0),
refs AS (SELECT curso, carpeta, subcarpeta, o_orderpriority AS modelo FROM orders JOIN everyone ON o_custkey = c_custkey WHERE o_orderstatus = 'P')
"""

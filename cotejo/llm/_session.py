"""Session helpers: tables in the shared folder, and how many ways to deal work."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the cluster's ``spark.checkpoint.dir``. Where that is unset a temporary folder
    takes its place on a local master, as in tests; on any other an error is raised, since
    executors would not see each other's files there.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share; master is {master!r}")
        at = "file://" + tempfile.mkdtemp(prefix="cotejo-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back.

    Lost executors then cost a reread of files, not a rerun of the plan above.
    """
    spark = df.sparkSession
    path = new_table_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes the files of a table of the shared folder that nothing will read again; ``df`` is what ``written`` gave."""
    shared, jvm = shared_dir(df.sparkSession), df.sparkSession._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(folder)
        if folder.split(":", 1)[-1].lstrip("/").startswith(shared.split(":", 1)[-1].lstrip("/")):
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """``df`` as a table in the shared folder, dealt into one bucket for each shuffle partition by ``column``.

    Joins on ``column`` then move the other side only. The table is external: the
    session's catalog knows it for the length of the session, its files lie with the others.
    """
    spark = df.sparkSession
    path = new_table_path(spark, name)
    known = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.option("compression", "uncompressed").option("path", path).bucketBy(partitions(spark), column).saveAsTable(known)
    return spark.table(known)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder. One with fewer splits than there are cores is small, and is dealt out to all of them."""
    found, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return found.repartition(cores) if found.rdd.getNumPartitions() < cores else found

"""The corpus tree ``course/assignment/problem/files`` and the generated references, as DataFrames.

File listings come from Spark's binaryFile reader, so any store that Spark reads will do.
Directories without code files are invisible to it; where the caller lists them
(``directories``, one path each), problems without code are kept with a count of 0. Spark
passes over files whose names begin with a dot or an underscore.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.functions.text import model_of, valid_utf8, version_of
from cotejo.sources.schemas import FILE, KEY, REFERENCE_FILE

CODE = r"\.(c|cpp)$"
REFERENCE = r"^referencia_.*\.c$"
MAX_UPLOAD_BYTES = 5 * 1024 * 1024


def _segment(path: Column, from_end: int) -> Column:
    return F.get(F.reverse(F.split(F.regexp_replace(path, "/+$", ""), "/")), F.lit(from_end))


def _listing(spark: SparkSession, root: str, glob: str, content: bool) -> DataFrame | None:
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(f"{root.rstrip('/')}/*/*/*/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return found if content else found.select("path", "length")


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """FILE rows of all ``*.c`` and ``*.cpp`` files exactly four levels below ``root``."""
    found = _listing(spark, root, "*.{c,cpp}", content=True)
    return spark.createDataFrame([], FILE) if found is None else files_of(found)


def files_of(listing: DataFrame) -> DataFrame:
    """FILE rows of a listing (path, content)."""
    return listing.select(
        _segment(F.col("path"), 3).alias("curso"),
        _segment(F.col("path"), 2).alias("carpeta"),
        _segment(F.col("path"), 1).alias("subcarpeta"),
        _segment(F.col("path"), 0).alias("archivo"),
        F.regexp_extract(_segment(F.col("path"), 0), CODE, 1).alias("ext"),
        valid_utf8(F.col("content")).alias("contenido"),
    )


def problem_inventory(files: DataFrame, directories: DataFrame | None = None) -> DataFrame:
    """PROBLEM rows with the number of code files; listed directories without any count 0."""
    counted = files.groupBy(*KEY).agg(F.count("*").alias("num_archivos"))
    if directories is None:
        return counted
    listed = directories.select(*[_segment(F.col("path"), k).alias(c) for c, k in zip(KEY, (2, 1, 0), strict=True)]).distinct()
    both = listed.withColumn("num_archivos", F.lit(0).cast("long")).unionByName(counted)
    return both.groupBy(*KEY).agg(F.sum("num_archivos").alias("num_archivos"))


def problem_keys(inventory: DataFrame) -> DataFrame:
    return inventory.select(*KEY).distinct()


def problems_by_assignment(inventory: DataFrame) -> DataFrame:
    """How many different problems each course and assignment has."""
    return inventory.groupBy("curso", "carpeta").agg(F.count_distinct("subcarpeta").alias("problemas"))


def scan_references(spark: SparkSession, root: str) -> DataFrame:
    """REFERENCE_FILE rows of ``referencia_v{n}_{model}.c`` files; names without a model are passed over."""
    found = _listing(spark, root, "referencia_*.c", content=False)
    return spark.createDataFrame([], REFERENCE_FILE) if found is None else references_of(found)


def references_of(listing: DataFrame) -> DataFrame:
    """REFERENCE_FILE rows of a listing (path)."""
    name = _segment(F.col("path"), 0)
    return listing.select(
        *[_segment(F.col("path"), k).alias(c) for c, k in zip(KEY, (3, 2, 1), strict=True)],
        version_of(name).alias("version"),
        model_of(name).alias("modelo"),
    ).filter(F.col("modelo").isNotNull())


def acceptable_uploads(files: DataFrame, name: str = "archivo", size: str = "bytes") -> DataFrame:
    """Uploads with a C or C++ name, in any case, of at most 5 MB."""
    return files.filter(F.lower(name).rlike(CODE) & (F.col(size) <= MAX_UPLOAD_BYTES))

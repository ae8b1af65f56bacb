"""Statements, checkpoints, reference metadata and the catalogue of text models."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.sources.schemas import KEY, METADATA, MODEL, STATEMENT

# The catalogue of models, as name, provider and the provider's name for it.
MODELS = (
    ("gpt-4o-mini", "openai", "gpt-4o-mini"),
    ("gpt-4o", "openai", "gpt-4o"),
    ("gpt-4-turbo", "openai", "gpt-4-turbo"),
    ("claude-3-haiku", "anthropic", "claude-3-haiku-20240307"),
    ("claude-3-sonnet", "anthropic", "claude-3-sonnet-20240229"),
    ("claude-3-opus", "anthropic", "claude-3-opus-20240229"),
    ("ollama-codellama", "ollama", "codellama"),
    ("ollama-llama3", "ollama", "llama3"),
    ("ollama-mistral", "ollama", "mistral"),
    ("gemini-flash", "litellm", "gemini/gemini-1.5-flash"),
    ("gemini-1.5-pro", "litellm", "gemini/gemini-1.5-pro"),
    ("gemini-3-flash-lite-preview", "litellm", "gemini/gemini-3.1-flash-lite-preview"),
)


def model_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, MODEL)


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """STATEMENT rows of a CSV with a header, of a folder of such or of a store, and ``pos``, their order.

    In a store that ``append_statements`` writes, batches stand in the order of their numbers, the files of a batch in that of
    their names. Other files come before them, in the order in which they were modified. However large files
    are and in whatever order Spark reads them, ``pos`` sorts rows as they were written: a file is read by one task.
    """
    read = spark.read.option("recursiveFileLookup", True).csv(path, schema=STATEMENT, header=True, multiLine=True, quote='"', escape='"')
    file = F.col("_metadata.file_path")
    batch = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(file, r"/lote=(\d{9,})/[^/]*$", 1), F.lit("")), F.lit("999999999999")).cast("long"), F.lit(-1).cast("long"))
    changed = F.when(batch < 0, F.unix_micros("_metadata.file_modification_time")).otherwise(0)
    pos = F.struct(batch.alias("lote"), changed.alias("cambio"), file.alias("archivo"), F.monotonically_increasing_id().alias("n"))
    return read.select(*STATEMENT.fieldNames(), pos.alias("pos"))


def last_wins(rows: DataFrame, keys: list[str], order: str = "pos") -> DataFrame:
    """Of rows with one key the last, at the place of the first: column ``order`` becomes the first's."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    last = F.max_by(F.struct(*rest), F.col(order)).alias("last")
    picked = rows.groupBy(*keys).agg(F.min(order).alias(order), last)
    return picked.select(*keys, *[F.col("last")[c].alias(c) for c in rest], order)


def limited(rows: DataFrame, n: int | None, order: str = "pos") -> DataFrame:
    """The first ``n`` rows in order; 0 or None is no limit."""
    if n is not None and n < 0:
        raise ValueError("a limit is 0 or more")
    return rows.orderBy(order).limit(n) if n else rows


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """Completed keys of JSON lists of triples and of the table that ``append_completed`` writes.

    What is missing, or no such list, gives none.
    """
    schema = ", ".join(f"{c} string" for c in KEY)
    try:
        text = spark.read.text(path, wholetext=True, pathGlobFilter="*.{json,txt}")
        table = spark.read.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    keys = text.select(F.explode(F.from_json("value", "array<array<string>>")).alias("k"))
    return keys.select(*[F.get("k", F.lit(i)).alias(c) for i, c in enumerate(KEY)]).unionByName(table).dropna()


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row for each reference of ``metadata.json`` documents, times as naive timestamps."""
    read = spark.read.json(path, schema=METADATA, multiLine=True).select(F.inline("references"))
    return read.withColumn("timestamp", F.try_to_timestamp("timestamp").cast("timestamp_ntz"))


def latest_metadata(metadata: DataFrame) -> DataFrame:
    """Of runs repeated for one (asignacion, modelo, version) the latest."""
    rest = [c for c in metadata.columns if c not in ("asignacion", "modelo", "version")]
    last = metadata.groupBy("asignacion", "modelo", "version").agg(F.max_by(F.struct(*rest), "timestamp").alias("last"))
    return last.select("asignacion", "modelo", "version", "last.*").select(metadata.columns)

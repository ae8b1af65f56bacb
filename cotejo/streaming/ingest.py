"""Streams: new programs as they arrive, and sessions of IDE events. An extension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cotejo.functions.text import content_hash
from cotejo.sources.schemas import CODIGO_FUENTE


def arriving_code(spark: SparkSession, path: str) -> DataFrame:
    """CODIGO_FUENTE rows of Parquet files that are put into a folder."""
    return spark.readStream.schema(CODIGO_FUENTE).parquet(path).withColumn("hash", content_hash(F.col("contenido_raw")))


def process(stream: DataFrame, checkpoint: str, into: Callable[[DataFrame, int], None], *, once: bool = True) -> StreamingQuery:
    """Each batch to ``into(rows, batch_id)``; after a restart it goes on where the checkpoint says."""
    writer = stream.writeStream.foreachBatch(into).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", user: str = "user_id", at: str = "ts") -> DataFrame:
    """Sessions of events at most ``gap`` apart, of a stream or a table."""
    marked = events.withWatermark(at, late) if events.isStreaming else events
    grouped = marked.groupBy(F.session_window(at, gap).alias("w"), F.col(user)).agg(F.count("*").alias("n"))
    return grouped.select(user, F.col("w.start").alias("inicio"), F.col("w.end").alias("fin"), "n")

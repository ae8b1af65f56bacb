"""A learned style model: logistic regression on hashed character n-grams, trained by Spark.

The counts are those of ``HashingTF``; they are made once of every text, on whole Arrow columns, and kept as a table of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from cotejo.functions import gram_hash
from cotejo.operators.similarity import _kernel_fits
from cotejo.sources.scratch import scratch_path

#: Characters of texts that are counted at once.
CHARS = 1 << 20


def gram_vectors(texts: DataFrame, key: str, *, text: str = "text", n: int = 3, features: int = 1 << 12) -> DataFrame:
    """key and ``features``: how often each text's runs of ``n`` lower-cased characters fall into each of so many buckets, as a table of sparse vectors."""
    parts = "type:tinyint,size:int,indices:array<int>,values:array<double>"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            rows = batch.column("grams").to_pylist()
            ends = np.cumsum([len(t) for t in rows])
            lo = 0
            while lo < len(rows):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHARS, "right")))
                if len(known) > CHARS:
                    known.clear()
                of, buckets, counts = gram_hash.gram_counts(rows[lo:hi], n, features, known)
                edges = pa.array(np.searchsorted(of, np.arange(hi - lo + 1)), pa.int32())
                columns = [
                    pa.array(np.zeros(hi - lo, np.int8)), pa.array(np.full(hi - lo, features, np.int32)),
                    pa.ListArray.from_arrays(edges, pa.array(buckets, pa.int32())), pa.ListArray.from_arrays(edges, pa.array(counts.astype(float))),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(lo, hi - lo), pa.StructArray.from_arrays(columns, ["type", "size", "indices", "values"])], [key, "features"])
                lo = hi

    kind = texts.schema[key].dataType
    rows = texts.select(key, F.coalesce(F.lower(text), F.lit("")).alias("grams")).mapInArrow(counted, f"`{key}` {kind.simpleString()}, features struct<{parts}>")
    path = scratch_path(texts.sparkSession, "gram-vectors")
    rows.write.option("compression", "zstd").parquet(path)
    # a vector is stored as this very struct
    return texts.sparkSession.read.schema(StructType([StructField(key, kind), StructField("features", VectorUDT())])).parquet(path)


def fitted(vectors: DataFrame, labels: DataFrame, key: str, label: str) -> PipelineModel:
    """A model from all labelled texts of ``gram_vectors``; a label is 0 or 1, rows without one are passed over."""
    known = labels.filter(F.col(label).isin(0, 1)).select(key, F.col(label).cast("double").alias("label"))
    # labels that fit go to the vectors, which are not shuffled then
    known = F.broadcast(known) if _kernel_fits(known, 16) else known
    return Pipeline(stages=[LogisticRegression(maxIter=15, regParam=0.01)]).fit(vectors.join(known, key).select("features", "label"))


def scores(model: PipelineModel, vectors: DataFrame, key: str) -> DataFrame:
    """key and ``probabilidad`` of label 1 for every text of ``gram_vectors``."""
    scored = model.transform(vectors)
    return scored.select(key, F.round(F.get(vector_to_array("probability"), F.lit(1)), 6).alias("probabilidad"))


def train(texts: DataFrame, labels: DataFrame, key: str, label: str, *, text: str = "text", n: int = 3, features: int = 1 << 12) -> PipelineModel:
    """A model from all labelled texts."""
    known = labels.filter(F.col(label).isin(0, 1)).select(key).distinct()
    return fitted(gram_vectors(texts.join(known, key, "left_semi"), key, text=text, n=n, features=features), labels, key, label)


def probabilities(model: PipelineModel, texts: DataFrame, key: str, *, text: str = "text", n: int = 3, features: int = 1 << 12) -> DataFrame:
    """key and ``probabilidad`` of label 1 for every text."""
    return scores(model, gram_vectors(texts, key, text=text, n=n, features=features), key)

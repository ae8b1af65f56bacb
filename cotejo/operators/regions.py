"""Matched regions of two texts: every longest run of characters that both hold, from fingerprints with their places.

Winnowing keeps one k-gram of each ``window``. Runs of ``k + window - 1`` characters or more that two texts share have a
kept k-gram in common at the same distance from the run's beginning, so shared fingerprints on one *diagonal* (place in one text less
place in the other) that stand no further apart than k cover one run. They are joined by fingerprint, chained by gaps and islands, and each
chain is made longer character by character as far as both texts agree. A fingerprint that very many texts
hold is dealt into parts of the one side, each of which meets the other side's rows; none is left out.

Places count from 0 in the *packed* text: lower-cased, without white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotejo.sources.scratch import kept

#: Rows of one fingerprint that meet the other side in one part.
HOT = 2000


def packed(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"\s+", "")


def _kept_grams(text: str, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the k-grams that winnowing keeps: in each run of ``window`` the one of least hash, of equals the last."""
    units = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(units) - k + 1
    if n < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    hashes = np.zeros(n, np.uint64)
    for j in range(k):
        hashes = hashes * _BASE + units[j : j + n]
    hashes = (hashes ^ (hashes >> np.uint64(29))) * _MIX
    hashes ^= hashes >> np.uint64(32)
    width = min(window, n)
    last = width - 1 - np.lib.stride_tricks.sliding_window_view(hashes, width)[:, ::-1].argmin(axis=1)
    pos = np.unique(np.arange(len(last)) + last)
    return hashes[pos], pos


_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def places(texts: DataFrame, key: str, k: int, window: int) -> DataFrame:
    """``key``, fingerprint and pos of the k-grams of (key, packed) that winnowing keeps; hashes only choose what is compared."""
    kind = texts.schema[key].dataType.simpleString()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in enumerate(batch.column("packed").to_pylist()):
                hashes, pos = _kept_grams(text, k, window)
                keys = batch.column(key).take(pa.array(np.full(len(pos), row)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(hashes.view(np.int64)), pa.array(pos.astype(np.int32))], [key, "fingerprint", "pos"])

    return texts.select(key, "packed").mapInArrow(found, f"{key} {kind}, fingerprint long, pos int")


def met(left: DataFrame, right: DataFrame, hot: int = HOT) -> DataFrame:
    """Rows of ``left`` and ``right`` (key, fingerprint, pos; ``right``'s pos as other_pos) that share a fingerprint.

    A fingerprint with more than ``hot`` rows on the left is dealt into parts there, and repeated for each part on the right.
    """
    right = right.withColumnRenamed("pos", "other_pos")
    asked = left.join(right.select("fingerprint").distinct(), "fingerprint", "left_semi")
    often = asked.groupBy("fingerprint").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("fingerprint", F.ceil(F.col("n") / hot).cast("int").alias("parts"))
    often = kept(often, "hot-fingerprints")
    parts = F.coalesce("parts", F.lit(1))
    dealt = asked.join(often, "fingerprint", "left").withColumn("part", F.pmod(F.xxhash64(*left.columns), parts).cast("int")).drop("parts")
    repeated = right.join(often, "fingerprint", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return dealt.join(repeated, ["fingerprint", "part"]).drop("part")


def _agreeing(a: Column, b: Column, most: int) -> Column:
    """How many first characters of ``a`` and ``b`` agree, ``most`` at most."""
    same = lambda i: (F.length(a) >= i) & (F.length(b) >= i) & (F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.size(F.filter(F.sequence(F.lit(1), F.lit(most)), same))


def matched_regions(texts: DataFrame, references: DataFrame, key: str, reference: str, k: int = 12, window: int = 8, hot: int = HOT) -> DataFrame:
    """``key``, ``reference``, inicio, inicio_ref and largo of every longest common run of ``k + window - 1`` characters or more.

    Of texts and references with ``key`` and text. ``window`` is k at most, so that a chain leaves no character out.
    """
    if not 1 <= window <= k:
        raise ValueError(f"window must be 1 to {k}, not {window}")
    one = kept(texts.select(key, packed(F.col("text")).alias("packed")).filter(F.length("packed") >= k), "packed-texts")
    two = kept(references.select(reference, packed(F.col("text")).alias("packed")).filter(F.length("packed") >= k), "packed-references")
    shared = met(places(one, key, k, window), places(two, reference, k, window), hot).withColumn("diagonal", F.col("pos") - F.col("other_pos"))
    line = Window.partitionBy(key, reference, "diagonal").orderBy("pos")
    starts = shared.withColumn("new", (F.coalesce(F.col("pos") - F.lag("pos").over(line), F.lit(k + 1)) > k).cast("int"))
    chains = starts.withColumn("chain", F.sum("new").over(line)).groupBy(key, reference, "diagonal", "chain").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    both = chains.join(one.withColumnRenamed("packed", "x"), key).join(two.withColumnRenamed("packed", "y"), reference)
    before = lambda text, at: F.reverse(F.substring(text, F.greatest(at - window, F.lit(0)) + 1, F.least(at, F.lit(window))))
    behind = lambda text, at: F.substring(text, at + 1, F.lit(window))
    a, b = F.col("first"), F.col("last") + k
    wider = both.select(
        key,
        reference,
        "diagonal",
        (a - _agreeing(before(F.col("x"), a), before(F.col("y"), a - F.col("diagonal")), window)).alias("lo"),
        (b + _agreeing(behind(F.col("x"), b), behind(F.col("y"), b - F.col("diagonal")), window)).alias("hi"),
        (F.substring("x", a + 1, b - a) == F.substring("y", a - F.col("diagonal") + 1, b - a)).alias("equal"),
    ).filter("equal")
    found = wider.filter(F.col("hi") - F.col("lo") >= k + window - 1).select(key, reference, F.col("lo").alias("inicio"), (F.col("lo") - F.col("diagonal")).alias("inicio_ref"), (F.col("hi") - F.col("lo")).alias("largo"))
    return found.distinct()


def coverage_of(regions: DataFrame, key: str, reference: str) -> DataFrame:
    """How many characters of a text its regions with one reference cover, each once, and the longest region."""
    line = Window.partitionBy(key, reference).orderBy("inicio", "largo")
    reached = F.max(F.col("inicio") + F.col("largo")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    end = F.col("inicio") + F.col("largo")
    fresh = F.greatest(end - F.greatest(F.coalesce(reached, F.lit(0)), "inicio"), F.lit(0))
    return regions.withColumn("fresh", fresh).groupBy(key, reference).agg(F.sum("fresh").alias("cubierto"), F.max("largo").alias("mayor"), F.count("*").alias("regiones"))

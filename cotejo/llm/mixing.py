"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every document of a source is expected ``rate = target / source_size`` times.
The expected copies are prefix-summed in a fixed order within the source, one
random offset per source is added, and a document is taken once for every
integer boundary that its stretch of the sum crosses. As the order runs by size,
the words taken differ from the target by about one document at most.

The prefix sum needs each document's rank in its source. No source is ranked in
one task: documents are numbered in buckets (source, size class, salt), of which a class has
one for every ``BUCKET_ROWS`` documents, and the counts of the buckets are summed in two windows.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; null ids are dealt by their texts; repeated rows are taken or not one by one;
a source without words has target 0 and nothing of it is taken; an empty table
gives an empty result. Only id, text and source are read, so other columns never clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotejo.llm._session import written

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a size class that are numbered in one bucket, about.
BUCKET_ROWS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _digest(value: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """One row per source: source_size, target and offset, from rows (source, size).

    Targets are weight * level, cut at cap * source_size, for the one level at
    which they add up to the share. Sources that are cut stand first when ordered
    by size over weight, so the level is read off prefix sums. Those two windows
    have one row per source and no partition.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(in_order) - 1
    weighed = per_source.withColumn("place", place).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    )
    by_room = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    all_rows = by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cut_before = F.coalesce(F.sum("source_size").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight_left = F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    level = (share * F.sum("source_size").over(all_rows) - cap * cut_before) / weight_left
    leveled = weighed.withColumn("level", level)
    uncut = F.when(cap * F.col("source_size") / F.col("weight") > F.col("level"), F.col("level"))
    leveled = leveled.withColumn("final", F.first(uncut, ignorenulls=True).over(all_rows))
    target = F.least(cap * F.col("source_size"), F.col("weight") * F.col("final"))
    return leveled.select(
        "source",
        "source_size",
        F.coalesce(target, cap * F.col("source_size")).alias("target"),
        (_digest(F.concat(F.lit("offset of "), F.coalesce("source", F.lit(""))), 6) / 2**24).alias("offset"),
    )


def mix_sources(
    docs: DataFrame,
    *,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and text_key of every row of ``docs``."""
    bits = F.length(F.bin("size"))
    dealt_by = _digest(F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit("")), 7)
    sized = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), dealt_by.alias("dealt_by"), F.xxhash64("text").alias("text_key")), "mix-sizes")
    classed = sized.select(
        "doc_id",
        "size",
        "text_key",
        "dealt_by",
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"),
        (bits * 16 + F.expr("mod(shiftright(size, greatest(length(bin(size)) - 5, 0)), 16)")).alias("class"),
    )
    salts = written(classed.groupBy("key", "class").agg((F.floor(F.count("*") / BUCKET_ROWS) + 1).alias("salts")), "mix-salts")
    placed = classed.join(salts, ["key", "class"]).withColumn("salt", F.col("dealt_by") % F.col("salts"))
    by_salt = Window.partitionBy("key", "class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    by_class = Window.partitionBy("key").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    buckets = placed.groupBy("key", "class", "salt").agg(F.count("*").alias("n"))
    classes = (
        buckets.groupBy("key", "class")
        .agg(F.sum("n").alias("n"))
        .select("key", "class", F.coalesce(F.sum("n").over(by_class), F.lit(0)).alias("class_before"))
    )
    buckets = buckets.select("key", "class", "salt", F.coalesce(F.sum("n").over(by_salt), F.lit(0)).alias("salt_before"))
    targets = source_targets(sized, weights, share, cap).select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"), "source_size", "target", "offset"
    )
    buckets = written(buckets.join(classes, ["key", "class"]).join(targets, "key"), "mix-buckets")
    ranked = placed.withColumn(
        "nth", F.row_number().over(Window.partitionBy("key", "class", "salt").orderBy("size", "doc_id", "text_key"))
    ).join(buckets, ["key", "class", "salt"])
    rank = F.col("class_before") + F.col("salt_before") + F.col("nth")
    rate = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    crossed = F.floor(rank * rate + F.col("offset")) - F.floor((rank - 1) * rate + F.col("offset"))
    return ranked.withColumn("copies", crossed.cast("long")).select(
        "doc_id",
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        "copies",
        "text_key",
    )


def take_copies(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; columns stay as they are.

    Of rows that repeat id and text the one whose columns hash lowest (maps, which have no
    hash, aside) stands for all, and comes as often as the mix takes them together.
    """
    ids = mixed.groupBy(F.col("doc_id").alias("_mix_id"), F.col("text_key").alias("_mix_text")).agg(F.sum("copies").cast("int").alias("_mix_copies"), F.count("*").alias("_mix_rows"))
    keyed = docs.withColumn("_mix_key", F.xxhash64("text"))
    wanted = ids.filter("_mix_copies > 0")
    # by text as well, or rows without an id would all meet in one task
    joined = keyed.join(wanted, (F.col("_mix_key") == F.col("_mix_text")) & F.col("doc_id").eqNullSafe(F.col("_mix_id")))
    single = joined.filter("_mix_rows = 1").select("_mix_copies", *docs.columns)
    hashed = F.xxhash64(*(f.name for f in docs.schema if "map<" not in f.dataType.simpleString()))
    several = joined.filter("_mix_rows > 1").groupBy("_mix_key", "_mix_id").agg(F.first("_mix_copies").alias("_mix_copies"), F.min_by(F.struct(*docs.columns), hashed).alias("row"))
    both = single.unionByName(several.select("_mix_copies", "row.*"))
    return both.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), "_mix_copies"))).select(docs.columns)


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(text), '')), 1, 7))::BIGINT AS dealt_by
  FROM documents),
per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM per_source),
weighed AS (SELECT *, CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM placed),
leveled AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
      - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / (sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed),
final AS (SELECT arg_min(level, (source_size::DOUBLE / weight, place)) AS level FROM leveled WHERE 2.0::DOUBLE * source_size / weight > level),
targets AS (
  SELECT source, source_size, coalesce(least(2.0::DOUBLE * source_size, weight * (SELECT level FROM final)), 2.0::DOUBLE * source_size) AS target,
    ('0x' || substr(md5('offset of ' || coalesce(source, '')), 1, 6))::BIGINT / 16777216.0::DOUBLE AS u
  FROM leveled),
classed AS (
  SELECT *, length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 5, 0)) % 16 AS class FROM sized),
salted AS (SELECT *, dealt_by % (count(*) OVER (PARTITION BY source, class) // 4096 + 1) AS salt FROM classed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, salt, size, doc_id NULLS FIRST) AS k FROM salted),
taken AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, r.k, t.u,
    CASE WHEN t.source_size = 0 THEN 0.0::DOUBLE ELSE t.target / t.source_size::DOUBLE END AS rate
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
copied AS (SELECT *, CAST(floor(k * rate + u) - floor((k - 1) * rate + u) AS BIGINT) AS copies FROM taken)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, copies FROM copied
"""

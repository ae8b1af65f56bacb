"""Lineage of files in traces: which events belong to one file, through all its names.

An event is of the file that its name stands for at that moment: the last event before it that gave the name, an as-of join of
events to the events ``created`` and ``rename``. A renamed file goes on from the one that had the old name just before; these
steps are followed by doubling, so a chain of n renames takes about log2(n) joins. A name that was there before the trace began
stands for an initial file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotejo.sources.scratch import kept

CREATED, RENAMED = "created", "rename"


def _last_naming(rows: DataFrame, trace: str, upto: int, order: list[str]) -> DataFrame:
    """``rows`` (name, seq, gives) with ``by``: the last seq that gave the name, ``upto`` rows from the row itself."""
    line = Window.partitionBy(trace, "name").orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    return rows.withColumn("by", F.last(F.when(F.col("gives"), F.col("seq")), ignorenulls=True).over(line))


def _initial(name: Column) -> Column:
    return F.concat(F.lit("inicial:"), name)


def file_lineage(events: DataFrame, trace: str = "file", seq: str = "seq", kind: str = "text", name: str = "filename", old: str = "old_filename") -> DataFrame:
    """trace, seq, name and identidad of every event with a name; seq is its place in the trace, different for each.

    Events of one file have one identidad: ``creado:`` and the place of its creation, or ``inicial:`` and its name where it was
    there before. A deleted file keeps it until its name is given anew.
    """
    own = events.filter(F.col(name).isNotNull()).select(trace, F.col(seq).cast("long").alias("seq"), F.col(kind).alias("kind"), F.col(name).alias("name"), F.col(old).alias("old"))
    gives = F.col("kind").isin(CREATED, RENAMED)
    placed = kept(_last_naming(own.withColumn("gives", gives), trace, 0, ["seq"]), "lineage-events")
    renames = placed.filter(F.col("kind") == RENAMED)
    asked = renames.filter(F.col("old").isNotNull()).select(trace, F.col("old").alias("name"), "seq", F.lit(False).alias("gives"), F.lit(True).alias("asks"))
    given = placed.filter("gives").select(trace, "name", "seq", "gives", F.lit(False).alias("asks"))
    # of one event the question stands before what it gives, also where a file takes its own name
    before = _last_naming(asked.unionByName(given), trace, -1, ["seq", "gives"]).filter("asks").select(trace, "seq", F.col("by").alias("up"))
    created = F.concat(F.lit("creado:"), F.col("seq").cast("string"))
    start = placed.filter("gives").join(before, [trace, "seq"], "left").select(trace, "seq", "up", F.when(F.col("kind") == CREATED, created).when(F.col("up").isNull(), _initial(F.coalesce("old", "name"))).alias("root"))
    steps = kept(start.withColumn("up", F.when(F.col("root").isNull(), F.col("up"))), "lineage-steps")
    while not steps.filter("root is null").isEmpty():
        above = steps.select(trace, F.col("seq").alias("up"), F.col("up").alias("next"), F.col("root").alias("found"))
        steps = kept(steps.join(above, [trace, "up"], "left").select(trace, "seq", F.when(F.coalesce("root", "found").isNull(), F.col("next")).alias("up"), F.coalesce("root", "found").alias("root")), "lineage-steps")
    roots = steps.select(trace, F.col("seq").alias("by"), "root")
    return placed.join(roots, [trace, "by"], "left").select(trace, "seq", "name", F.coalesce("root", _initial(F.col("name"))).alias("identidad"))

"""Ground truth of copied work, and traces of a programming environment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cotejo.sources.schemas import IDE_TRACE


def parse_ground_truth(texts: DataFrame) -> DataFrame:
    """curso, carpeta, subcarpeta, group_id and student, from whole texts (file, value).

    A line ``- course/assignment/problem`` heads the groups that follow, one a line,
    students separated by commas. Group ids count the group lines of a file from 1.
    """
    lines = texts.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    in_file = Window.partitionBy("file").orderBy("pos")
    is_head = F.startswith(F.col("line"), F.lit("- "))
    headed = lines.filter("line <> ''").select(
        "file",
        "pos",
        "line",
        is_head.alias("is_head"),
        F.last(F.when(is_head, F.substring("line", 3, 1 << 30)), ignorenulls=True).over(in_file).alias("head"),
        F.count_if(~is_head).over(in_file).alias("group_id"),
    )
    groups = headed.filter("not is_head and head is not null")
    part = lambda k: F.get(F.split(F.trim("head"), "/"), F.lit(k))
    return groups.select(
        part(0).alias("curso"),
        part(1).alias("carpeta"),
        part(2).alias("subcarpeta"),
        F.col("group_id").cast("int").alias("group_id"),
        F.explode(F.filter(F.transform(F.split("line", ","), lambda x: F.trim(x)), lambda x: x != "")).alias("student"),
    )


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return parse_ground_truth(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value"))


def guilty_pairs(truth: DataFrame) -> DataFrame:
    """Unordered pairs of students of one group. A group is one line of a file, a few students; ``guilty_counts`` counts pairs of any group without making them."""
    key = ["curso", "carpeta", "subcarpeta", "group_id"]
    other = truth.withColumnRenamed("student", "student_b")
    pairs = truth.withColumnRenamed("student", "student_a").join(other, key)
    return pairs.filter("student_a < student_b").distinct()


def guilty_counts(truth: DataFrame) -> DataFrame:
    """carpeta, student_a and n: with how many different students of greater name each shares a group in an assignment.

    That is the student's place in the group, counted from its end. Only pairs of students who are both in several groups are listed, for they may meet twice.
    """
    key = ["curso", "carpeta", "subcarpeta", "group_id"]
    known = truth.filter(" and ".join(f"{c} is not null" for c in (*key, "student"))).select(*key, "student").distinct()
    after = F.count("*").over(Window.partitionBy(*key).orderBy(F.desc("student")).rowsBetween(Window.unboundedPreceding, -1))
    groups = F.count("*").over(Window.partitionBy("carpeta", "student"))
    counted = known.withColumn("n", after).withColumn("groups", groups)
    several = counted.filter("groups > 1").select(*key, F.col("student").alias("student_a"))
    again = several.join(several.withColumnRenamed("student_a", "student_b"), key).filter("student_a < student_b").groupBy("carpeta", "student_a", "student_b").agg((1 - F.count("*")).alias("n"))
    each = counted.select("carpeta", F.col("student").alias("student_a"), "n").unionByName(again.filter("n < 0").select("carpeta", "student_a", "n"))
    return each.groupBy("carpeta", "student_a").agg(F.sum("n").alias("n")).filter("n > 0")


def compared_truth(static: DataFrame, dynamic: DataFrame) -> DataFrame:
    """The union of two truth sets, with ``in_static`` and ``in_dynamic``: both for what they share, one for what only it has."""
    keys = static.columns
    each = static.distinct().select(*keys, F.lit(True).alias("s"), F.lit(False).alias("d")).unionByName(
        dynamic.distinct().select(*keys, F.lit(False).alias("s"), F.lit(True).alias("d"))
    )
    return each.groupBy(*keys).agg(F.max("s").alias("in_static"), F.max("d").alias("in_dynamic"))


def parse_traces(texts: DataFrame) -> DataFrame:
    """One row for each path of each trace (file, value): its counters, results, events and entries."""
    paths = texts.select("file", F.explode(F.from_json("value", IDE_TRACE)).alias("path", "trace"))
    return paths.select("file", "path", "trace.*")


def ratio(text: Column) -> Column:
    """``"X/Y"`` as a number; null where it is none or Y is 0."""
    part = lambda k: F.try_to_number(F.split_part(text, F.lit("/"), F.lit(k)), F.lit("999999999")).cast("double")
    return F.try_divide(part(1), part(2))


def trace_events(traces: DataFrame) -> DataFrame:
    events = traces.select("file", "path", F.explode("events").alias("e")).select("file", "path", "e.*")
    return events.withColumn("at", F.timestamp_seconds("time"))


def trace_activity(traces: DataFrame) -> DataFrame:
    """Sums of each file's counters, and the mean share of tests passed."""
    return traces.groupBy("file").agg(
        F.sum("total_time").alias("total_time"),
        F.sum("builds").alias("builds"),
        F.sum("builds_succeeded").alias("builds_succeeded"),
        F.sum("testings").alias("testings"),
        F.avg(ratio(F.col("last_test_results"))).alias("passed"),
    )

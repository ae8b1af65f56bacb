"""Retries as timers: a failing generator against the schedule, and a restart from the checkpoint."""

import time

import pytest
from pyspark.sql import functions as F

from cotejo.functions.text import MAX_RETRIES
from cotejo.streaming import retries


def failing(folder):
    """Fails as often as the prompt says, which a file for each prompt counts; "fatal" fails for good."""

    def call(prompts):
        out = []
        for prompt in prompts:
            name, failures = prompt.split(":")
            seen = folder / name
            times = len(seen.read_text()) if seen.exists() else 0
            seen.write_text("x" * (times + 1))
            if failures == "fatal":
                raise ValueError("no such model")
            out.append((None, "503 UNAVAILABLE") if times < int(failures) else (f"answer of {name}", None))
        return out

    return call


@pytest.fixture
def source(spark, tmp_path):
    tasks = [("a", "a:0"), ("b", "b:2"), ("c", "c:fatal"), ("d", "d:99"), ("e", "e:1")]
    spark.createDataFrame(tasks, "task string, prompt string").write.parquet(str(tmp_path / "tasks"))
    (tmp_path / "seen").mkdir()
    return lambda: spark.readStream.schema("task string, prompt string").parquet(str(tmp_path / "tasks"))


def test_waits_follow_the_schedule(spark, tmp_path, source):
    table = str(tmp_path / "out")
    query = retries.start(source(), failing(tmp_path / "seen"), table, str(tmp_path / "c"), first_wait=0.05, every="0 seconds")
    over = {r.task: r for r in retries.drained(spark, query, table, 5, 300).collect()}
    assert {k: (r.state, r.intentos) for k, r in over.items()} == {"a": ("done", 1), "b": ("done", 3), "c": ("failed", 1), "d": ("exhausted", MAX_RETRIES + 1), "e": ("done", 2)}
    assert over["b"].answer == "answer of b" and "no such model" in over["c"].error
    assert over["d"].espera_s == pytest.approx(0.05 * (2**MAX_RETRIES - 1))
    asked = spark.read.parquet(table).filter("task = 'd'").orderBy("retry").select("retry", "wait_s", F.unix_micros("at").alias("t")).collect()
    assert [r.retry for r in asked] == list(range(MAX_RETRIES + 1)) and [r.wait_s for r in asked] == [0.05 * 2**k for k in range(MAX_RETRIES)] + [None]
    assert all(b.t - a.t >= a.wait_s * 1e6 - 2000 for a, b in zip(asked, asked[1:], strict=False))


def test_restart_goes_on_where_it_stood(spark, tmp_path, source):
    table, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")
    call = failing(tmp_path / "seen")
    query = retries.start(source(), call, table, checkpoint, first_wait=2.0, every="0 seconds")
    until = time.time() + 120
    while time.time() < until and len(list((tmp_path / "seen").iterdir())) < 5:
        time.sleep(0.2)
    while time.time() < until and (not query.lastProgress or spark.read.parquet(table).count() < 5):
        time.sleep(0.3)
    query.stop()
    first = spark.read.parquet(table).count()
    assert 5 <= first < 13
    again = retries.start(source(), call, table, checkpoint, first_wait=0.05, every="0 seconds")
    over = {r.task: (r.state, r.intentos) for r in retries.drained(spark, again, table, 5, 300).collect()}
    assert over == {"a": ("done", 1), "b": ("done", 3), "c": ("failed", 1), "d": ("exhausted", MAX_RETRIES + 1), "e": ("done", 2)}
    assert spark.read.parquet(table).groupBy("task", "retry").count().filter("count > 1").isEmpty()

"""Tasks that are asked, and asked again, as a stream: a wait is a timer of the state store, not a sleeping task.

Each task is a key. What is kept of an open one is its prompt and the number of the retry; a processing-time timer
is due when the wait is over: ``first_wait`` * 2**retry seconds after a failure that may pass. Other failures, and the
last retry's, end the task. State and timers lie in the query's checkpoint, so after a restart
open tasks go on where they stood, and those whose time came meanwhile are asked at once.
"""

from __future__ import annotations

import contextlib
import time
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from cotejo.functions.text import FIRST_WAIT, MAX_RETRIES, RETRYABLE
from cotejo.operators.generators import Call

#: One row for each time a task was asked: ``state`` is done, retry (then ``wait_s`` is how long until the next), failed or exhausted.
ATTEMPTS = "task string, answer string, error string, retry int, state string, wait_s double, at timestamp"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Retrying(StatefulProcessor):
    """``call`` gets one prompt at a time; what it raises is the task's error."""

    def __init__(self, call: Call, first_wait: float = FIRST_WAIT, most: int = MAX_RETRIES):
        self.call, self.first_wait, self.most = call, first_wait, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "prompt string, retry int")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        prompts = [r["prompt"] for r in rows]
        if not self.open.exists():  # a task that is open already is not asked twice
            yield self._ask(key[0], prompts[0], 0)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        prompt, retry = self.open.get()
        yield self._ask(key[0], prompt, retry + 1)

    def _ask(self, task: str, prompt: str, retry: int) -> Row:
        try:
            answer, error = self.call([prompt])[0]
        except Exception as e:  # the model's own errors decide whether the task is asked again
            answer, error = None, f"{type(e).__name__}: {e}"
        now, wait = time.time(), None
        if error is None:
            state = "done"
        elif not any(x in error for x in RETRYABLE):
            state = "failed"
        else:
            state = "retry" if retry < self.most else "exhausted"
        if state == "retry":
            wait = float(self.first_wait * 2**retry)
            self.open.update((prompt, retry))
            self.handle.registerTimer(int((now + wait) * 1000))
        elif self.open.exists():
            self.open.clear()
        return Row(task=task, answer=answer, error=error, retry=retry, state=state, wait_s=wait, at=datetime.fromtimestamp(now, timezone.utc))

    def close(self) -> None:
        pass


@contextlib.contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """Timers need the RocksDB store; a query takes the setting with it when it starts."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def attempts(tasks: DataFrame, call: Call, first_wait: float = FIRST_WAIT, most: int = MAX_RETRIES) -> DataFrame:
    """ATTEMPTS of a stream of (task, prompt)."""
    keyed = tasks.select("task", "prompt").groupBy("task")
    return keyed.transformWithState(Retrying(call, first_wait, most), ATTEMPTS, "append", "ProcessingTime")


def start(tasks: DataFrame, call: Call, path: str, checkpoint: str, *, first_wait: float = FIRST_WAIT, most: int = MAX_RETRIES, every: str = "1 second") -> StreamingQuery:
    """Asks the tasks of a stream and appends every attempt to the table at ``path``; each is there once, whatever restarts."""
    with _state_store(tasks.sparkSession):
        out = attempts(tasks, call, first_wait, most).writeStream.format("parquet").option("path", path)
        return out.option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=every).start()


def ended(attempted: DataFrame) -> DataFrame:
    """task, answer, error and state of the tasks that are over, with the number of their attempts and the seconds waited."""
    whole = attempted.groupBy("task").agg(
        F.count("*").alias("intentos"), F.coalesce(F.sum("wait_s"), F.lit(0.0)).alias("espera_s"), F.max_by(F.struct("answer", "error", "state"), "retry").alias("last")
    )
    return whole.filter("last.state <> 'retry'").select("task", "last.*", "intentos", "espera_s")


def drained(spark: SparkSession, query: StreamingQuery, path: str, tasks: int, seconds: float = 600) -> DataFrame:
    """``ended`` of the table at ``path`` as soon as ``tasks`` tasks are over; then the query is stopped."""
    until = time.time() + seconds
    try:
        while True:
            time.sleep(0.2)
            if query.exception():
                raise query.exception()
            with contextlib.suppress(AnalysisException):  # no table yet
                over = ended(spark.read.schema(ATTEMPTS).parquet(path))
                if over.count() >= tasks:
                    return over
            if time.time() > until:
                raise TimeoutError(f"tasks are still open after {seconds} s")
    finally:
        query.stop()

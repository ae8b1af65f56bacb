"""What answers tasks and what makes feature columns: a small protocol with a registry.

A generator reads a task table (task, prompt) and gives an answer table (task, answer, error); a
featurizer reads programs (key, text) and gives one row of features for each key. Both are
functions from DataFrame to DataFrame, so a model that is called live is a ``mapInArrow``
or ``mapInPandas`` function, and a model that has been called already is a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Generator = Callable[[DataFrame], DataFrame]
Featurizer = Callable[[DataFrame], DataFrame]
#: One batch of prompts to as many (answer, error) pairs.
Call = Callable[[list[str]], list[tuple[str | None, str | None]]]

ANSWERS = "task string, answer string, error string"
_generators: dict[str, Generator] = {}
_featurizers: dict[str, Featurizer] = {}


def register_generator(name: str, generator: Generator) -> None:
    _generators[name] = generator


def register_featurizer(name: str, featurizer: Featurizer) -> None:
    _featurizers[name] = featurizer


def generator(name: str) -> Generator:
    if name not in _generators:
        raise KeyError(f"no generator {name!r}; known: {sorted(_generators)}")
    return _generators[name]


def featurizer(name: str) -> Featurizer:
    if name not in _featurizers:
        raise KeyError(f"no featurizer {name!r}; known: {sorted(_featurizers)}")
    return _featurizers[name]


def from_table(answers: DataFrame) -> Generator:
    """A generator that looks answers up by the prompt's hash; tasks without one have no row."""
    return lambda tasks: tasks.select("task").join(answers, "task").select("task", "answer", "error")


def calling(call: Call) -> Generator:
    """A generator that calls a model with each batch of prompts; what it raises is each task's error."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prompts = batch.column("prompt").to_pylist()
            try:
                said = call(prompts)
            except Exception as e:  # the model's own errors become rows, to be tried again or not
                said = [(None, f"{type(e).__name__}: {e}")] * len(prompts)
            answers, errors = zip(*said, strict=True) if said else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("task"), pa.array(answers, pa.string()), pa.array(errors, pa.string())], ["task", "answer", "error"])

    return lambda tasks: tasks.select("task", "prompt").mapInArrow(ask, ANSWERS)

"""Tasks for text models, and what becomes of the answers.

A task table holds prompts; answers are a table too, joined by the prompt's hash. Whoever
calls a model live plugs in a ``mapInPandas`` function that reads tasks and yields answers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cotejo.functions.text import fenced_code, is_retryable, parse_statement, reference_name, reference_prompt, statement_prompt
from cotejo.sources.schemas import KEY


def first_files(files: DataFrame, n: int = 2, keys: list[str] = KEY) -> DataFrame:
    """The first ``n`` files of each problem, .c before .cpp, then by name."""
    rank = F.when(F.col("ext") == "c", 0).otherwise(1)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(rank, "archivo"))
    return files.withColumn("place", place).filter(F.col("place") <= n)


def seeded_choice(files: DataFrame, seed: str = "0", keys: list[str] = KEY, by: str = "archivo") -> DataFrame:
    """One file of each problem, the one whose name hashes lowest with the seed; the same in every run."""
    order = F.struct(F.md5(F.concat(F.lit(seed), F.lit(":"), F.col(by).cast("string"))), F.col(by))
    rest = [c for c in files.columns if c not in keys]
    return files.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("one")).select(*keys, "one.*")


def inference_tasks(problems: DataFrame, files: DataFrame, n: int = 2) -> DataFrame:
    """One prompt for each problem with code, from its first two files."""
    codes = first_files(files, n).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("place", "contenido"))).alias("codes"))
    code = lambda k: F.get("codes", F.lit(k))["contenido"]
    prompted = problems.join(codes, KEY).select(*KEY, statement_prompt(code(0), code(1)).alias("prompt"))
    return prompted.withColumn("task", F.sha2("prompt", 256))


def known_models(models: DataFrame, catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The wanted models (nombre) with provider and model, and those that the catalogue does not know."""
    return models.join(catalogue, "nombre"), models.join(catalogue, "nombre", "left_anti")


def generation_tasks(statements: DataFrame, originals: DataFrame, models: DataFrame, versions: int = 3) -> DataFrame:
    """A prompt for each statement with an original, model and version."""
    each = statements.join(originals, KEY).crossJoin(F.broadcast(models))  # models: a short list
    each = each.withColumn("version", F.explode(F.sequence(F.lit(1), F.lit(versions))))
    prompt = reference_prompt(F.col("enunciado"), F.col("contenido"))
    name = reference_name(F.col("version"), F.col("nombre"))
    return each.select(*KEY, "enunciado", "nombre", "version", name.alias("archivo"), prompt.alias("prompt")).withColumn("task", F.sha2("prompt", 256))


def answered(tasks: DataFrame, answers: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Tasks with ``answer`` and ``error``; a task without either is still open."""
    joined = tasks.join(answers, on or ["task"], "left")
    state = F.when(F.col("answer").isNotNull(), "done").when(F.col("error").isNull(), "open").when(is_retryable(F.col("error")), "retry").otherwise("failed")
    return joined.withColumn("state", state)


def statements_of(done: DataFrame) -> DataFrame:
    enunciado, lenguaje = parse_statement(F.col("answer"))
    return done.filter("state = 'done'").select(*KEY, enunciado.alias("enunciado"), lenguaje.alias("lenguaje"))


def references_of(done: DataFrame, compat: bool = False) -> DataFrame:
    return done.filter("state = 'done'").select(*KEY, "nombre", "version", "archivo", fenced_code(F.col("answer"), compat).alias("codigo"))


def skip_reasons(statements: DataFrame, problems: DataFrame, completed: DataFrame) -> DataFrame:
    """Statements with the reason why they are not worked on; null for those that are."""
    known = problems.select(*KEY, "num_archivos")
    done = completed.select(*KEY).distinct().withColumn("is_done", F.lit(True))
    joined = statements.join(known, KEY, "left").join(done, KEY, "left")
    reason = F.when(F.col("num_archivos").isNull(), "path missing").when(F.col("num_archivos") == 0, "no code").when(F.col("is_done"), "completed")
    return joined.select(*statements.columns, reason.alias("skip_reason"))

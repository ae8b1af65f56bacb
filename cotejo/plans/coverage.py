"""Queries on coverage and generation tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.functions.bands import variations
from cotejo.functions.text import retry_wait
from cotejo.operators import coverage, tasks
from cotejo.plans._tables import SQL, problems, references, table
from cotejo.sources.corpus import problems_by_assignment
from cotejo.sources.schemas import KEY
from cotejo.sources.statements import MODELS, last_wins, model_catalogue


def coverage_by_problem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.export_rows(problems(spark, sf_dir), references(spark, sf_dir))


def coverage_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = coverage.by_problem(problems(spark, sf_dir), references(spark, sf_dir))
    return rows.filter("total > 0").select(*KEY, "total", F.explode("modelos").alias("modelo", "n"))


def coverage_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.by_group(problems(spark, sf_dir), references(spark, sf_dir))


def coverage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.totals(problems(spark, sf_dir), references(spark, sf_dir))


def coverage_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested document, read back to one row for each covered problem."""
    document = coverage.nested_document(problems(spark, sf_dir), references(spark, sf_dir))
    rows = document.select(F.col("dataset.total_problemas"), F.col("referencias.total").alias("total_referencias"), F.inline("referencias.por_problema"))
    return rows.select("total_problemas", "total_referencias", "problema", "total", F.to_json("modelos").alias("modelos"))


def references_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.references_by_model(references(spark, sf_dir))


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return problems_by_assignment(problems(spark, sf_dir))


def pending_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.pending(problems(spark, sf_dir), references(spark, sf_dir)).select(*KEY)


def eligible_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = coverage.eligible(references(spark, sf_dir), problems(spark, sf_dir))
    return found.groupBy(*KEY, "modelo").agg(F.count("*").alias("n"))


def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = references(spark, sf_dir).select(*KEY).distinct()
    done = references(spark, sf_dir).filter("modelo = '1-URGENT'")
    return tasks.skip_reasons(wanted, problems(spark, sf_dir), done)


def known_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted models by the catalogue, unknown ones with nulls."""
    wanted = spark.createDataFrame([(m[0],) for m in MODELS] + [("otro",)], "nombre string")
    known, unknown = tasks.known_models(wanted, model_catalogue(spark))
    return known.select("nombre", "provider", "model").unionByName(unknown, allowMissingColumns=True)


def generation_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task for each statement, model and version: benchmark items by the catalogue."""
    items = table(spark, sf_dir, "benchmark").select(
        F.lit("B").alias("curso"), F.lit("item").alias("carpeta"), F.col("item_id").cast("string").alias("subcarpeta"), F.col("text").alias("enunciado")
    )
    originals = items.select(*KEY, F.col("enunciado").alias("contenido"))
    made = tasks.generation_tasks(items, originals, model_catalogue(spark).select("nombre"), 3)
    return made.select("subcarpeta", "nombre", "version", "archivo", "task")


def seeded_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "lang", "doc_id")
    return tasks.seeded_choice(docs, "7", ["source", "lang"], "doc_id")


def sample_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = docs.select("source", F.col("lang").alias("ext"), F.col("doc_id").alias("archivo"))
    return tasks.first_files(files, 2, ["source", "ext"]).select("source", "ext", "archivo", F.col("place").cast("long").alias("place"))


def statements_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations").select("conv_id", "role", F.col("turn").alias("pos"), "text")
    return last_wins(talk, ["conv_id", "role"])


def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    retries = spark.range(6).select(F.col("id").alias("retry"))
    return retries.select("retry", retry_wait(F.col("retry")).alias("wait_s"), F.sum(retry_wait(F.col("retry"))).over(_by_retry()).alias("waited_s"))


def _by_retry():
    from pyspark.sql import Window

    return Window.orderBy("retry")  # six rows


def variation_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", variations(F.col("p_size") - 5).cast("long").alias("variaciones"))


_MODELS = ", ".join(f"('{n}', '{p}', '{m}')" for n, p, m in MODELS)
_PROMPT = r"""'Given this problem description: "' || text || '"' || chr(10) || 'And this original solution:' || chr(10) || '```c' || chr(10) || left(text, 1500) || chr(10) || '```' || chr(10) || chr(10)
  || 'Generate a functionally equivalent code but with a DIFFERENT implementation approach.' || chr(10)
  || 'Do NOT copy the logic directly - use alternative algorithms where possible.' || chr(10) || 'The output should be clean, compilable C code.' || chr(10)"""

QUERIES = {
    f.__name__: f
    for f in (
        coverage_by_problem, coverage_models, coverage_by_group, coverage_totals, coverage_document, references_by_model, assignments, pending_problems,
        eligible_references, skip_reasons, known_models, generation_tasks, seeded_choice, sample_files, statements_last_wins, retry_schedule, variation_clamp,
    )
}
ORACLES = {
    "coverage_by_problem": SQL + "SELECT p.curso, p.carpeta, p.subcarpeta, num_archivos AS archivos_originales, count(modelo) AS referencias_ia "
    "FROM problems p LEFT JOIN refs r USING (curso, carpeta, subcarpeta) GROUP BY ALL",
    "coverage_models": SQL + ", c AS (SELECT curso, carpeta, subcarpeta, modelo, count(*) AS n FROM refs GROUP BY ALL) "
    "SELECT curso, carpeta, subcarpeta, CAST(sum(n) OVER (PARTITION BY curso, carpeta, subcarpeta) AS BIGINT) AS total, modelo, n FROM c SEMI JOIN problems USING (curso, carpeta, subcarpeta)",
    "coverage_by_group": SQL + ", p AS (SELECT curso || '/' || carpeta AS grupo, count(*) AS n FROM problems GROUP BY 1), r AS (SELECT curso || '/' || carpeta AS grupo, count(*) AS n FROM refs GROUP BY 1) "
    "SELECT grupo, coalesce(p.n, 0) AS problemas, coalesce(r.n, 0) AS referencias FROM p FULL JOIN r USING (grupo)",
    "coverage_totals": SQL + "SELECT (SELECT count(*) FROM problems) AS total_problemas, (SELECT count(*) FROM refs) AS total_referencias, "
    "(SELECT count(*) FROM refs ANTI JOIN problems USING (curso, carpeta, subcarpeta)) AS referencias_huerfanas",
    "coverage_document": SQL + ", c AS (SELECT curso, carpeta, subcarpeta, modelo, count(*) AS n FROM refs SEMI JOIN problems USING (curso, carpeta, subcarpeta) GROUP BY ALL) "
    "SELECT (SELECT count(*) FROM problems) AS total_problemas, (SELECT count(*) FROM refs) AS total_referencias, curso || '/' || carpeta || '/' || subcarpeta AS problema, "
    "CAST(sum(n) AS BIGINT) AS total, '{' || string_agg('\"' || modelo || '\":' || n, ',' ORDER BY modelo) || '}' AS modelos FROM c GROUP BY curso, carpeta, subcarpeta",
    "references_by_model": SQL + "SELECT modelo, count(*) AS n, count(DISTINCT (curso, carpeta, subcarpeta)) AS problemas FROM refs GROUP BY modelo",
    "assignments": SQL + "SELECT curso, carpeta, count(DISTINCT subcarpeta) AS problemas FROM problems GROUP BY ALL",
    "pending_problems": SQL + "SELECT curso, carpeta, subcarpeta FROM problems p WHERE NOT EXISTS (SELECT 1 FROM refs r WHERE (r.curso, r.carpeta, r.subcarpeta) = (p.curso, p.carpeta, p.subcarpeta))",
    "eligible_references": SQL + "SELECT curso, carpeta, subcarpeta, modelo, count(*) AS n FROM refs r WHERE EXISTS (SELECT 1 FROM problems p "
    "WHERE (r.curso, r.carpeta, r.subcarpeta) = (p.curso, p.carpeta, p.subcarpeta) AND num_archivos > 0) GROUP BY ALL",
    "skip_reasons": SQL + "SELECT DISTINCT r.curso, r.carpeta, r.subcarpeta, CASE WHEN num_archivos IS NULL THEN 'path missing' WHEN num_archivos = 0 THEN 'no code' "
    "WHEN EXISTS (SELECT 1 FROM refs d WHERE (r.curso, r.carpeta, r.subcarpeta) = (d.curso, d.carpeta, d.subcarpeta) AND d.modelo = '1-URGENT') THEN 'completed' END AS skip_reason "
    "FROM refs r LEFT JOIN problems p USING (curso, carpeta, subcarpeta)",
    "known_models": f"SELECT nombre, provider, model FROM (VALUES {_MODELS}, ('otro', NULL, NULL)) t(nombre, provider, model)",
    "generation_tasks": f"SELECT CAST(item_id AS VARCHAR) AS subcarpeta, nombre, CAST(version AS INTEGER) AS version, 'referencia_v' || version || '_' || nombre || '.c' AS archivo, sha256({_PROMPT}) AS task "
    f"FROM benchmark CROSS JOIN (VALUES {_MODELS}) t(nombre, provider, model) CROSS JOIN range(1, 4) v(version)",
    "seeded_choice": "SELECT source, lang, arg_min(doc_id, (md5('7:' || doc_id), doc_id)) AS doc_id FROM documents GROUP BY ALL",
    "sample_files": "SELECT source, lang AS ext, doc_id AS archivo, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS place FROM documents QUALIFY place <= 2",
    "statements_last_wins": "SELECT conv_id, role, min(turn) AS pos, arg_max(text, turn) AS text FROM conversations GROUP BY ALL",
    "retry_schedule": "SELECT r AS retry, CAST(30 * 2 ** r AS BIGINT) AS wait_s, CAST(sum(30 * 2 ** r) OVER (ORDER BY r) AS BIGINT) AS waited_s FROM range(6) t(r)",
    "variation_clamp": "SELECT p_partkey, CAST(greatest(1, least(10, p_size - 5)) AS BIGINT) AS variaciones FROM part",
}

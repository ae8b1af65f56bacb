"""The relational store: teachers, problems, code, reports and findings, one folder for each table.

Any format that Spark reads will do; the schemas are given, so columns that a file lacks are null
and others are passed over. A database comes in the same way, as ``jdbc`` reads of the same names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.operators.report import full_reports, of_teacher
from cotejo.sources.schemas import CODIGO_FUENTE, DOCENTE, INDICADOR_INTEGRIDAD, PROBLEMA, REPORTE_ANALISIS

TABLES = {"docente": DOCENTE, "problema": PROBLEMA, "codigo_fuente": CODIGO_FUENTE, "reporte_analisis": REPORTE_ANALISIS, "indicador_integridad": INDICADOR_INTEGRIDAD}


def read_store(spark: SparkSession, path: str, kind: str = "parquet", **options: str) -> dict[str, DataFrame]:
    """Every table of the store by name."""
    return {name: spark.read.schema(schema).format(kind).options(**options).load(f"{path.rstrip('/')}/{name}") for name, schema in TABLES.items()}


def write_store(tables: dict[str, DataFrame], path: str, kind: str = "parquet") -> None:
    """Appends rows to the tables named."""
    for name, rows in tables.items():
        rows.select(TABLES[name].names).write.mode("append").format(kind).save(f"{path.rstrip('/')}/{name}")


def teacher_reports(store: dict[str, DataFrame], teacher: int) -> DataFrame:
    """The reports on submissions to one teacher's problems, with problem, teacher and both authors."""
    code = store["codigo_fuente"]
    mine = of_teacher(store["reporte_analisis"], code, store["problema"], F.lit(teacher))
    return full_reports(mine, code, store["problema"], store["docente"])

"""Reports on two channels: logical similarity and style, with bands and indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.functions.bands import is_equivalent, risk_band, semantic_band
from cotejo.functions.vectors import fused_cosine

#: From here on a style counts as synthetic.
SYNTHETIC = 0.5


def two_channel_report(logic: DataFrame, style: DataFrame, on: str) -> DataFrame:
    """``logic`` (on, referencia, similitud) and ``style`` (on, probabilidad, peso) as one report."""
    joined = logic.join(style, on)
    weighed = F.round(F.col("probabilidad") * F.col("peso"), 6)
    whole = F.round(fused_cosine(F.col("similitud"), weighed), 6)
    report = joined.select(on, "referencia", F.col("similitud").alias("similitud_logica"), weighed.alias("probabilidad_sintetica"), whole.alias("similitud_global"))
    return report.withColumns(
        {
            "banda": semantic_band(F.col("similitud_logica")),
            "riesgo": risk_band(F.round(100 * F.col("similitud_global"), 4)),
            "prioridad": is_equivalent(F.col("similitud_logica")),
        }
    )


def findings(report: DataFrame, on: str) -> DataFrame:
    """One row for each finding (tipo_hallazgo) of each report."""
    high, synthetic = F.col("similitud_logica") >= 0.8, F.col("probabilidad_sintetica") >= SYNTHETIC
    listed = F.array(
        F.when(high, F.lit("equivalencia_alta")),
        F.when(high & synthetic, F.lit("discrepancia_canales")),
        F.when(synthetic, F.lit("estilo_sintetico")),
        F.when(F.col("referencia").isNull(), F.lit("sin_referencia")),
    )
    return report.select(on, F.explode(F.filter(listed, lambda x: x.isNotNull())).alias("tipo_hallazgo"))


def analysable(code: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that can be analysed, and those that are turned away before."""
    flagged = code.withColumn("is_valid", F.coalesce(valid, F.lit(False)))
    return flagged.filter("is_valid").drop("is_valid"), flagged.filter("not is_valid").drop("is_valid")


def of_teacher(reports: DataFrame, submissions: DataFrame, problems: DataFrame, teacher: Column) -> DataFrame:
    """Reports on submissions to a teacher's own problems only."""
    mine = problems.filter(F.col("docente_id") == teacher).select(F.col("id").alias("problema_id"))
    own = submissions.join(mine, "problema_id", "left_semi").select(F.col("id").alias("entrega_id"))
    return reports.join(own, "entrega_id", "left_semi")


def full_reports(reports: DataFrame, code: DataFrame, problems: DataFrame, teachers: DataFrame) -> DataFrame:
    """Reports with problem and teacher, and with the authors on both sides."""
    submitted = code.select(F.col("id").alias("entrega_id"), "problema_id", F.col("autor_id").alias("autor_entrega"))
    referred = code.select(F.col("id").alias("referencia_id"), F.col("autor_id").alias("autor_referencia"))
    owned = problems.select(F.col("id").alias("problema_id"), "docente_id", "titulo")
    named = teachers.select(F.col("id").alias("docente_id"), "nombre")
    return reports.join(submitted, "entrega_id").join(referred, "referencia_id", "left").join(owned, "problema_id").join(named, "docente_id")


def new_references(code: DataFrame) -> DataFrame:
    """What may be indexed as a reference: never a submission."""
    return code.filter("es_referencia")


def seen_before(code: DataFrame, known: DataFrame, digest: Column) -> DataFrame:
    """Rows of ``code`` whose content hash is in ``known`` (hash)."""
    return code.withColumn("hash", digest).join(known.select("hash"), "hash", "left_semi")

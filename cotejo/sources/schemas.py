"""Schemas of the files and tables that the engine reads and writes. Nothing is inferred."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


S, I, L, D = StringType(), IntegerType(), LongType(), DoubleType()
KEY = ["curso", "carpeta", "subcarpeta"]

PROBLEM = _struct(curso=S, carpeta=S, subcarpeta=S, num_archivos=L)
FILE = _struct(curso=S, carpeta=S, subcarpeta=S, archivo=S, ext=S, contenido=S)
REFERENCE_FILE = _struct(curso=S, carpeta=S, subcarpeta=S, version=I, modelo=S)
STATEMENT = _struct(curso=S, carpeta=S, subcarpeta=S, enunciado=S, lenguaje=S)
METADATA_ITEM = _struct(asignacion=S, enunciado=S, codigo_original=S, modelo=S, version=I, timestamp=S)
METADATA = _struct(references=ArrayType(METADATA_ITEM))
MODEL = _struct(nombre=S, provider=S, model=S)
MESSAGE = _struct(role=S, content=S)

DOCENTE = _struct(id=I, nombre=S, correo=S, password_hash=S, fecha_registro=TimestampType())
PROBLEMA = _struct(id=I, docente_id=I, titulo=S, descripcion_tecnica=S, fecha_creacion=TimestampType())
CODIGO_FUENTE = _struct(id=I, problema_id=I, autor_id=S, es_referencia=BooleanType(), lenguaje=S, contenido_raw=S)
REPORTE_ANALISIS = _struct(
    id=I, entrega_id=I, referencia_id=I, similitud_logica=D, probabilidad_sintetica=D, similitud_global=D, fecha_generacion=TimestampType()
)
INDICADOR_INTEGRIDAD = _struct(id=I, reporte_id=I, tipo_hallazgo=S, descripcion=S)
VECTOR = _struct(
    id=S,
    embedding_hibrido=ArrayType(D),
    metadata=_struct(problema_id=S, lenguaje=S, es_referencia=BooleanType(), author_type=S),
)
CARD = _struct(
    id=I,
    title=S,
    category=S,
    categoryColor=S,
    description=S,
    updatedAt=S,
    activeComparisons=I,
    comparisons=ArrayType(_struct(id=I, title=S, subtitle=S, similarity=D)),
)

#: ``diff`` has no documented shape, so it stays raw.
IDE_EVENT = _struct(time=L, text=S, filename=S, old_filename=S, old_filepath=S, content=S, output=S, diff=S)
IDE_TRACE = MapType(
    S,
    _struct(
        total_time=L,
        builds=I,
        builds_succeeded=I,
        testings=I,
        last_test_results=S,
        last_revision=I,
        entries=ArrayType(S),
        events=ArrayType(IDE_EVENT),
    ),
)

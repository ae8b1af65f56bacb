"""Queries on files, traces, stores and program structure.

Files stand in for themselves: listings, JSON and text are made of the tables' columns, and what
is written is read back from the session's scratch folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.functions import text as T
from cotejo.functions.style import char_codes, style_features
from cotejo.operators import clones, coverage, flow, library, report, similarity
from cotejo.plans._tables import SQL, everyone, problems, references, table
from cotejo.plans.texts import _LITERAL, _strip, _without_comments
from cotejo.sources import corpus, relational, sinks, statements, traces
from cotejo.sources.schemas import KEY
from cotejo.sources.scratch import scratch_path


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree language / source / problem, with a byte that is no UTF-8 behind each text."""
    docs = table(spark, sf_dir, "documents")
    ext = F.when(F.col("doc_id") % 3 == 0, "cpp").otherwise("c")
    path = F.concat_ws("/", F.lit("file:/corpus"), "lang", "source", F.concat(F.lit("p"), F.col("doc_id") % 50), F.concat(F.lit("f"), F.col("doc_id"), F.lit("."), ext))
    return docs.select(path.alias("path"), F.encode(F.regexp_replace("text", "�", ""), "UTF-8").alias("content")).withColumn("content", F.concat("content", F.unhex(F.lit("FF"))))


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.files_of(_listing(spark, sf_dir)).select(*KEY, "archivo", "ext", F.sha2("contenido", 256).alias("hash"))


def problem_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems with code, and listed directories without any."""
    listed = table(spark, sf_dir, "nation").select(F.concat_ws("/", F.lit("file:/corpus"), F.lit("en"), "n_name", F.lit("vacio/")).alias("path"))
    return corpus.problem_inventory(corpus.files_of(_listing(spark, sf_dir)), listed)


def reference_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    name = F.when(F.col("o_orderkey") % 5 == 0, "referencia_v1.c").otherwise(F.concat(F.lit("referencia_v"), F.col("o_orderkey") % 4, F.lit("_my_m"), F.col("o_custkey") % 3, F.lit(".c")))
    path = F.concat_ws("/", F.lit("s3://bucket/out"), "o_orderstatus", "o_orderpriority", F.concat(F.lit("c"), "o_custkey"), name)
    return corpus.references_of(orders.select(path.alias("path"))).groupBy("curso", "carpeta", "version", "modelo").agg(F.count("*").alias("n"))


def accepted_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    name = F.concat("p_name", F.element_at(F.array(*map(F.lit, (".C", ".cpp", ".Cpp", ".py", ".c.txt"))), (F.col("p_size") % 5 + 1).cast("int")))
    return corpus.acceptable_uploads(parts.select("p_partkey", name.alias("archivo"), (F.col("p_partkey") * 997 * 1024 % 9_000_000).alias("bytes")))


def limited_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first seven conversations; the limit is the feature."""
    talk = table(spark, sf_dir, "conversations").filter("turn = 0").select("conv_id", F.col("conv_id").alias("pos"))
    return statements.limited(talk, 7).select("conv_id")


def completed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint in both its forms: keys appended as a table, and a JSON list of triples beside it."""
    path = scratch_path(spark, "completed")
    sinks.append_completed(problems(spark, sf_dir), path)
    triples = table(spark, sf_dir, "nation").agg(F.to_json(F.array_sort(F.collect_list(F.array(F.lit("J"), F.col("n_regionkey").cast("string"), "n_name")))).alias("value"))
    triples.write.mode("append").text(path)
    return statements.read_checkpoint(spark, path).groupBy("curso", "carpeta").agg(F.count_distinct("subcarpeta").alias("n"))


def stored_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements appended to CSV and read back."""
    talk = table(spark, sf_dir, "conversations")
    path = scratch_path(spark, "statements")
    sinks.append_statements(talk.select(F.col("role").alias("curso"), F.col("conv_id").cast("string").alias("carpeta"), F.col("turn").cast("string").alias("subcarpeta"), F.concat(F.lit(' "x", '), "text", F.lit("\n ")).alias("enunciado"), F.lit("C++").alias("lenguaje")), path)
    return statements.read_statements(spark, path).select(*KEY, F.sha2("enunciado", 256).alias("hash"), "lenguaje")


def reference_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest run of each reference, from a metadata document."""
    items = table(spark, sf_dir, "benchmark").withColumn("at", F.expr("TIMESTAMP_NTZ'2024-02-28 23:00:00' + make_dt_interval(0, cast(item_id as int), 0, 0)"))
    item = F.struct(
        F.concat(F.lit("Z"), F.col("item_id") % 4).alias("asignacion"), F.col("text").alias("enunciado"), F.lit("int x;").alias("codigo_original"),
        F.concat(F.lit("m"), F.col("item_id") % 3).alias("modelo"), (F.col("item_id") % 2).cast("int").alias("version"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
    )
    path = scratch_path(spark, "metadata")
    items.agg(F.to_json(F.struct(F.collect_list(item).alias("references"))).alias("value")).write.text(path)
    last = statements.latest_metadata(statements.read_metadata(spark, path))
    return last.select("asignacion", "modelo", F.col("version").cast("long").alias("version"), F.sha2("enunciado", 256).alias("hash"), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("momento"))


def stored_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coverage report as one CSV file, read back."""
    path = scratch_path(spark, "coverage")
    rows = coverage.export_rows(problems(spark, sf_dir), references(spark, sf_dir))
    sinks.write_coverage_csv(rows, path)
    return spark.read.csv(path, header=True, schema=rows.schema)


def stored_coverage_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested coverage document as JSON, read back."""
    path = scratch_path(spark, "coverage-json")
    document = coverage.nested_document(problems(spark, sf_dir), references(spark, sf_dir))
    sinks.write_coverage_json(document, path)
    return spark.read.schema(document.schema).json(path).select(F.inline("referencias.por_problema")).select("problema", "total")


def stored_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References appended by course and assignment, read back."""
    path = scratch_path(spark, "references")
    sinks.append_references(references(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("curso", "carpeta", "modelo").agg(F.count("*").alias("n"))


def stored_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports and their findings, read back and joined."""
    labels = table(spark, sf_dir, "labels")
    path = scratch_path(spark, "reports")
    sinks.write_reports(labels.select("doc_id", "quality"), labels.filter("toxic = 1").select("doc_id", F.lit("toxico").alias("tipo_hallazgo")), path)
    reports, findings = (spark.read.parquet(f"{path}/{t}") for t in ("reportes", "hallazgos"))
    return reports.join(findings, "doc_id", "left").select("doc_id", "quality", "tipo_hallazgo")


def stored_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One teacher's reports from a relational store: regions own nations, customers hand in code, orders are reports."""
    path = scratch_path(spark, "store")
    code = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("id"), F.col("c_nationkey").cast("int").alias("problema_id"), F.col("c_name").alias("autor_id"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("int").alias("id"), F.col("o_custkey").cast("int").alias("entrega_id"), (F.col("o_custkey") + 1).cast("int").alias("referencia_id"))
    made = {
        "docente": table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("id"), F.col("r_name").alias("nombre")),
        "problema": table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("id"), F.col("n_regionkey").cast("int").alias("docente_id"), F.col("n_name").alias("titulo")),
        "codigo_fuente": code,
        "reporte_analisis": orders,
        "indicador_integridad": orders.limit(0),
    }
    for name, rows in made.items():
        missing = [f for f in relational.TABLES[name] if f.name not in rows.columns]
        relational.write_store({name: rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})}, path)
    found = relational.teacher_reports(relational.read_store(spark, path), 2)
    return found.select(F.col("id").cast("long").alias("id"), "autor_entrega", "autor_referencia", "titulo", "nombre")


def current_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors stored twice, of which the later version counts."""
    path = scratch_path(spark, "vectors")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    sinks.upsert_vectors(vectors, path, 1)
    sinks.upsert_vectors(vectors.filter("id % 3 = 0").withColumn("embedding", F.transform("embedding", lambda x: x + x)), path, 2)
    return sinks.current_vectors(spark.read.parquet(path)).select("id", "label", F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("primero"))


def _truth_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ground-truth file for each nation: its customers in groups of one problem."""
    groups = everyone(spark, sf_dir).groupBy("curso", "carpeta", (F.col("c_custkey") % 20).alias("g")).agg(F.array_join(F.array_sort(F.collect_list("subcarpeta")), " ,").alias("line"))
    lines = groups.groupBy("curso", "carpeta").agg(F.array_sort(F.collect_list(F.struct("g", "line"))).alias("lines"))
    head = F.concat(F.lit("- "), "curso", F.lit("/"), "carpeta", F.lit("/P1\r\n\r\n"))
    return lines.select(F.col("carpeta").alias("file"), F.concat(head, F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("value"))


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = traces.parse_ground_truth(_truth_texts(spark, sf_dir))
    return truth.withColumn("group_id", F.col("group_id").cast("long"))


def guilty_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.guilty_counts(traces.parse_ground_truth(_truth_texts(spark, sf_dir)))


def truth_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static and dynamic truth: what both have, and what one of them has alone."""
    truth = everyone(spark, sf_dir).select("curso", "carpeta", F.col("subcarpeta").alias("student"), "c_custkey")
    one = lambda n: truth.filter(F.col("c_custkey") % n == 0).drop("c_custkey")
    return traces.compared_truth(one(2).unionByName(one(4)), one(3))


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trace for each customer: its orders are the paths."""
    key = F.col("o_orderkey")
    trace = F.struct(
        key.alias("total_time"), (key % 7).alias("builds"), (key % 3).alias("builds_succeeded"), (key % 5).alias("testings"),
        F.concat((key % 4).cast("string"), F.lit("/"), (key % 3).cast("string")).alias("last_test_results"),
        F.array(F.struct((key + 1_600_000_000).alias("time"), F.col("o_orderpriority").alias("text"))).alias("events"),
    )
    paths = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("/src/"), key, F.lit(".c")), trace)))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("file")).agg(F.to_json(paths).alias("value"))


def trace_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = traces.trace_activity(traces.parse_traces(_traces(spark, sf_dir)))
    return found.withColumn("passed", F.round("passed", 6))


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = traces.trace_events(traces.parse_traces(_traces(spark, sf_dir)))
    return found.select("file", "path", "text", F.unix_timestamp("at").alias("at"))


def retryable_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = ("HTTP 429", "bad key", "503 busy", "RateLimitError: x", "UNAVAILABLE", "timeout")
    error = F.element_at(F.array(*map(F.lit, marks)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "orders").groupBy(error.alias("error")).agg(F.count("*").alias("n")).select("error", "n", T.is_retryable(F.col("error")).alias("otra_vez"))


def _programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as small C programs."""
    step = "  if (n > 1) {\n    n = n - 1; // paso\n  }\n"
    text = F.concat(
        F.when(F.col("p_partkey") % 2 == 0, "/* ").otherwise("#define A \"//\"\n/* "), "p_name", F.lit(" */\nint f"), F.col("p_size"), F.lit("(int n) {\n"), F.repeat(F.lit(step), (F.col("p_size") % 4).cast("int")),
        F.lit("  int total = n + "), F.col("p_size") % 3, F.lit(";\n  total += n;\n  return total;\n}\n"),
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("contenido"))


def renamed_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _programs(spark, sf_dir).select("id", T.normalized(F.col("contenido")).alias("codigo"))


def structure_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nesting, functions and leading comments of programs."""
    features = style_features(F.col("contenido"))
    return _programs(spark, sf_dir).select("id", *[features[c].alias(c) for c in ("mean_nesting", "n_functions", "leading_comment")])


def clone_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clones.clone_classes(_programs(spark, sf_dir), "id")


def clone_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items they share tokens with, by type of copy; the stand-in for their cosine is the Jaccard similarity doubled."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("other"))
    pairs = similarity.shared_tokens(docs, items.withColumnRenamed("other", "text"), "doc_id", "item_id").filter("jaccard >= 0.3")
    full = pairs.join(docs, "doc_id").join(items, "item_id")
    tipo = clones.clone_type(F.col("text"), F.col("other"), F.col("jaccard"), 2 * F.col("jaccard"))
    return full.select("doc_id", "item_id", tipo.alias("tipo"))


def data_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each definition to its uses, counted by distance."""
    edges = flow.edges(_programs(spark, sf_dir), "id")
    return edges.groupBy("id", "name").agg(F.count("*").alias("n"), F.sum((F.col("dst") - F.col("src")).cast("long")).alias("tokens"))


def token_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three tokens in benchmark items, counted."""
    items = table(spark, sf_dir, "benchmark")
    grams = items.select("item_id", F.explode(similarity.ngrams(similarity.tokens(F.col("text")), 3)).alias("gram"))
    return grams.groupBy("item_id", "gram").agg(F.count("*").alias("n"))


def char_code_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", F.array_join(char_codes(F.lower("p_name"), "abcdefghijklm "), ",").alias("codes"))


def new_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") == "P").alias("es_referencia"))
    return report.new_references(code).select("o_orderkey")


def seen_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose content a document of the first source has too."""
    docs = table(spark, sf_dir, "documents")
    known = docs.filter("source = 'src0'").select(F.sha2("text", 256).alias("hash")).distinct()
    return report.seen_before(docs.select("doc_id", "text"), known, F.sha2("text", 256)).select("doc_id", "hash")


def comparison_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each segment's three best customers, by credit."""
    scored = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment", F.round(F.greatest(F.col("c_acctbal"), F.lit(0.0)) / 10_000, 6).alias("s"))
    found = library.comparisons(scored, "c_mktsegment", "s", most=3)
    return found.select("c_mktsegment", "activas", "mayor", F.array_join(F.transform("lista", lambda x: x["id"].cast("string")), ",").alias("lista"))


def sample_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("id"), F.col("r_name").alias("title"))
    return library.sample_cards(cards, 12).withColumn("id", F.col("id").cast("long"))


_PATH = "'f' || doc_id || '.' || CASE WHEN doc_id % 3 = 0 THEN 'cpp' ELSE 'c' END"
_PROGRAMS = (
    "(SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN '/* ' ELSE '#define A \"//\"' || chr(10) || '/* ' END || p_name || ' */' || chr(10) || 'int f' || p_size || '(int n) {' || chr(10) "
    "|| repeat('  if (n > 1) {' || chr(10) || '    n = n - 1; // paso' || chr(10) || '  }' || chr(10), p_size % 4) || '  int total = n + ' || p_size % 3 || ';' || chr(10) || '  total += n;' || chr(10) || '  return total;' || chr(10) || '}' || chr(10) AS text FROM part)"
)
_KEYWORD_LIST = "[" + ", ".join(f"'{k}'" for k in T.KEYWORDS) + "]"


def _layout(x: str) -> str:
    return _strip(f"regexp_replace({_without_comments(x)}, '[ \\t\\n\\x{{0B}}\\f\\r]+', ' ', 'g')")


def _normal(x: str) -> str:
    found = f"regexp_extract_all({_layout(x)}, '(?s){_LITERAL}|[A-Za-z_][A-Za-z0-9_]*|[0-9][A-Za-z0-9_]*|.')"
    return f"array_to_string(list_transform({found}, lambda x: CASE WHEN regexp_matches(x, '^[A-Za-z_]') AND NOT list_contains({_KEYWORD_LIST}, x) THEN 'ID' ELSE x END), '')"


_SET = "list_distinct(regexp_extract_all(lower({0}), '[a-z]+'))"
_FLOW_TOKEN = flow._TOKEN.replace("'", "''")
_TRUTH = "SELECT r_name AS curso, n_name AS carpeta, 'P1' AS subcarpeta, dense_rank() OVER (PARTITION BY n_name ORDER BY c_custkey % 20) AS group_id, c_name AS student FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"

QUERIES = {
    f.__name__: f
    for f in (
        corpus_files, problem_inventory, reference_files, accepted_uploads, limited_statements, completed_keys, stored_statements, reference_metadata, stored_coverage, stored_coverage_document,
        stored_references, stored_relations, stored_reports, current_vectors, ground_truth, guilty_pairs, truth_sets, trace_activity, trace_events, retryable_errors, renamed_code, structure_table, clone_classes,
        clone_types, data_flow, token_ngrams, char_code_table, new_references, seen_before, comparison_lists, sample_cards,
    )
}
ORACLES = {
    "corpus_files": f"SELECT lang AS curso, source AS carpeta, 'p' || doc_id % 50 AS subcarpeta, {_PATH} AS archivo, CASE WHEN doc_id % 3 = 0 THEN 'cpp' ELSE 'c' END AS ext, sha256(replace(text, chr(65533), '')) AS hash FROM documents",
    "problem_inventory": "SELECT lang AS curso, source AS carpeta, 'p' || doc_id % 50 AS subcarpeta, count(*) AS num_archivos FROM documents GROUP BY ALL UNION ALL SELECT 'en', n_name, 'vacio', 0 FROM nation",
    "reference_files": "SELECT o_orderstatus AS curso, o_orderpriority AS carpeta, CAST(o_orderkey % 4 AS INTEGER) AS version, 'm' || o_custkey % 3 AS modelo, count(*) AS n FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY ALL",
    "accepted_uploads": "SELECT p_partkey, archivo, bytes FROM (SELECT p_partkey, p_name || ['.C', '.cpp', '.Cpp', '.py', '.c.txt'][p_size % 5 + 1] AS archivo, p_partkey * 997 * 1024 % 9000000 AS bytes FROM part) WHERE regexp_matches(lower(archivo), '\\.(c|cpp)$') AND bytes <= 5242880",
    "limited_statements": "SELECT conv_id FROM conversations WHERE turn = 0 ORDER BY conv_id LIMIT 7",
    "completed_keys": SQL + "SELECT curso, carpeta, count(DISTINCT subcarpeta) AS n FROM problems GROUP BY ALL UNION ALL SELECT 'J', CAST(n_regionkey AS VARCHAR), count(DISTINCT n_name) FROM nation GROUP BY ALL",
    "stored_statements": "SELECT role AS curso, CAST(conv_id AS VARCHAR) AS carpeta, CAST(turn AS VARCHAR) AS subcarpeta, sha256(' \"x\", ' || text || chr(10) || ' ') AS hash, 'C++' AS lenguaje FROM conversations",
    "reference_metadata": "SELECT 'Z' || item_id % 4 AS asignacion, 'm' || item_id % 3 AS modelo, item_id % 2 AS version, sha256(arg_max(text, item_id)) AS hash, strftime(TIMESTAMP '2024-02-28 23:00:00' + to_hours(CAST(max(item_id) AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS momento FROM benchmark GROUP BY ALL",
    "stored_coverage": SQL + "SELECT p.curso, p.carpeta, p.subcarpeta, num_archivos AS archivos_originales, count(modelo) AS referencias_ia FROM problems p LEFT JOIN refs r USING (curso, carpeta, subcarpeta) GROUP BY ALL",
    "stored_coverage_document": SQL + "SELECT curso || '/' || carpeta || '/' || subcarpeta AS problema, count(*) AS total FROM refs SEMI JOIN problems USING (curso, carpeta, subcarpeta) GROUP BY ALL",
    "stored_references": SQL + "SELECT curso, carpeta, modelo, count(*) AS n FROM refs GROUP BY ALL",
    "stored_relations": "SELECT o_orderkey AS id, c.c_name AS autor_entrega, r.c_name AS autor_referencia, n_name AS titulo, r_name AS nombre FROM orders JOIN customer c ON o_custkey = c.c_custkey LEFT JOIN customer r ON o_custkey + 1 = r.c_custkey "
    "JOIN nation ON c.c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey = 2",
    "stored_reports": "SELECT doc_id, quality, CASE WHEN toxic = 1 THEN 'toxico' END AS tipo_hallazgo FROM labels",
    "current_vectors": "SELECT vec_id AS id, label, round(CASE WHEN vec_id % 3 = 0 THEN embedding[1] + embedding[1] ELSE embedding[1] END::DOUBLE, 5) AS primero FROM embeddings",
    "ground_truth": _TRUTH,
    "guilty_pairs": f"WITH t AS ({_TRUTH}) SELECT a.carpeta, a.student AS student_a, count(DISTINCT b.student) AS n FROM t a JOIN t b USING (curso, carpeta, subcarpeta, group_id) WHERE a.student < b.student GROUP BY ALL",
    "truth_sets": "SELECT r_name AS curso, n_name AS carpeta, c_name AS student, c_custkey % 2 = 0 AS in_static, c_custkey % 3 = 0 AS in_dynamic FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0",
    "trace_activity": "SELECT CAST(o_custkey AS VARCHAR) AS file, CAST(sum(o_orderkey) AS BIGINT) AS total_time, CAST(sum(o_orderkey % 7) AS BIGINT) AS builds, CAST(sum(o_orderkey % 3) AS BIGINT) AS builds_succeeded, "
    "CAST(sum(o_orderkey % 5) AS BIGINT) AS testings, round(avg(CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 4)::DOUBLE / (o_orderkey % 3)::DOUBLE END), 6) AS passed FROM orders GROUP BY o_custkey",
    "trace_events": "SELECT CAST(o_custkey AS VARCHAR) AS file, '/src/' || o_orderkey || '.c' AS path, o_orderpriority AS text, o_orderkey + 1600000000 AS at FROM orders",
    "retryable_errors": "SELECT e AS error, count(*) AS n, e NOT IN ('bad key', 'timeout') AS otra_vez FROM (SELECT ['HTTP 429', 'bad key', '503 busy', 'RateLimitError: x', 'UNAVAILABLE', 'timeout'][o_orderkey % 6 + 1] AS e FROM orders) GROUP BY e",
    "renamed_code": f"SELECT id, {_normal('text')} AS codigo FROM {_PROGRAMS}",
    "structure_table": "SELECT id, round(list_sum(list_transform(range(1, len(b) + 1), lambda i: CASE WHEN b[i] = '{' THEN len(list_filter(b[1:i], lambda x: x = '{')) - len(list_filter(b[1:i], lambda x: x = '}')) ELSE 0 END)) "
    "/ len(list_filter(b, lambda x: x = '{'))::DOUBLE, 6) AS mean_nesting, CAST(len(list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*\\s*\\([^(){};]*\\)\\s*\\{'), lambda x: NOT regexp_matches(x, '^(if|for|while|switch|catch)\\b'))) AS BIGINT) AS n_functions, "
    f"regexp_matches(text, '^\\s*(?://|/\\*)') AS leading_comment FROM (SELECT *, regexp_extract_all(text, '[{{}}]') AS b FROM {_PROGRAMS})",
    "clone_classes": f"SELECT id, min(id) OVER (PARTITION BY a) AS type_1, min(id) OVER (PARTITION BY b) AS type_2 FROM (SELECT id, {_layout('text')} AS a, {_normal('text')} AS b FROM {_PROGRAMS})",
    "clone_types": f"WITH d AS (SELECT doc_id, text, {_SET.format('text')} AS s FROM documents), b AS (SELECT item_id, text AS other, {_SET.format('text')} AS t FROM benchmark), "
    "p AS (SELECT *, round(len(list_intersect(s, t)) / (len(s) + len(t) - len(list_intersect(s, t)))::DOUBLE, 6) AS j FROM d JOIN b ON len(list_intersect(s, t)) > 0) "
    f"SELECT doc_id, item_id, CASE WHEN {_layout('text')} = {_layout('other')} THEN 'I' WHEN {_normal('text')} = {_normal('other')} THEN 'II' WHEN j >= 0.6 THEN 'III' WHEN 2 * j >= 0.8 THEN 'IV' END AS tipo FROM p WHERE j >= 0.3",
    "data_flow": f"WITH t AS (SELECT id, regexp_extract_all({_without_comments('text')}, '{_FLOW_TOKEN}') AS l FROM {_PROGRAMS}), u AS (SELECT id, unnest(l) AS token, unnest(range(0, len(l))) AS pos FROM t), "
    "w AS (SELECT *, lead(token) OVER p AS after, lag(token) OVER p AS before FROM u WINDOW p AS (PARTITION BY id ORDER BY pos)), "
    f"o AS (SELECT id, pos, token AS name, coalesce(after IN ('=', '+=', '-=', '*=', '/=', '%=', '&=', '|=', '^=', '++', '--') OR before IN ('++', '--'), false) AS def FROM w WHERE regexp_matches(token, '^[A-Za-z_][A-Za-z0-9_]*$') AND NOT list_contains({_KEYWORD_LIST}, token) AND coalesce(after, '') <> '('), "
    "e AS (SELECT *, max(CASE WHEN def THEN pos END) OVER (PARTITION BY id, name ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS src FROM o) SELECT id, name, count(*) AS n, CAST(sum(pos - src) AS BIGINT) AS tokens FROM e WHERE NOT def AND src IS NOT NULL GROUP BY ALL",
    "token_ngrams": "WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark) SELECT item_id, gram, count(*) AS n FROM (SELECT item_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS gram FROM t) GROUP BY ALL",
    "char_code_table": "SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ''), lambda c: CASE WHEN contains('abcdefghijklm ', c) THEN strpos('abcdefghijklm ', c) ELSE 0 END), ',') AS codes FROM part",
    "new_references": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'",
    "seen_before": "SELECT doc_id, sha256(text) AS hash FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE source = 'src0')",
    "comparison_lists": "WITH s AS (SELECT c_custkey AS id, c_mktsegment, round(greatest(c_acctbal, 0) / 10000::DOUBLE, 6) AS s FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY s DESC, id) AS k FROM s) "
    "SELECT c_mktsegment, count(*) AS activas, max(round(100 * s, 4)) AS mayor, string_agg(CAST(id AS VARCHAR), ',' ORDER BY k) FILTER (k <= 3) AS lista FROM r GROUP BY 1",
    "sample_cards": "SELECT i + 1 AS id, r_name || ' #' || (i + 1) AS title FROM range(12) t(i) JOIN (SELECT *, row_number() OVER (ORDER BY r_regionkey) - 1 AS k FROM region) ON k = i % (SELECT count(*) FROM region)",
}

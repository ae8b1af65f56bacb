"""Queries on similarity, reports, evaluation and the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.functions.bands import gauge_offset, is_significant, risk_band, semantic_band
from cotejo.functions.style import runs_of, style_features, style_weight, synthetic_probability
from cotejo.functions.vectors import cosine, edit_similarity, fused, fused_cosine
from cotejo.operators import evaluate, learned, library, report, similarity
from cotejo.plans._tables import everyone, table, texts
from cotejo.plans.texts import _PROBABILITY
from cotejo.sources.scratch import kept
from cotejo.streaming.ingest import sessions


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of searches: every row whose id is divisible by 100, against all rows."""
    return table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0")


def top_k_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarity.vector_search(_queries(spark, sf_dir), table(spark, sf_dir, "embeddings"), 5)
    return found.withColumn("lugar", F.col("lugar").cast("long"))


def similar_above_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the query set and all rows of its label with a cosine of 0.3 or more."""
    pairs = similarity.pairs_above(_queries(spark, sf_dir), table(spark, sf_dir, "embeddings"), 0.3)
    return pairs.select("vec_id", "ref_id", "similitud", semantic_band(F.col("similitud")).alias("banda"))


def similar_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its number of links: all others of its label with a cosine of 0.3 or more."""
    return similarity.link_counts(table(spark, sf_dir, "embeddings"), 0.3)


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine and Euclidean distance of the query set to each label."""
    return similarity.mean_distances(_queries(spark, sf_dir), table(spark, sf_dir, "embeddings"))


def fused_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results fused with a probability, by the closed form and by long vectors."""
    p = F.lit(0.5)
    q, v = _queries(spark, sf_dir), table(spark, sf_dir, "embeddings")
    best = similarity.vector_search(q, v, 5).select("vec_id", "ref_id")
    pairs = best.join(q.select("vec_id", F.col("embedding").alias("a")), "vec_id").join(v.select(F.col("vec_id").alias("ref_id"), F.col("embedding").alias("b")), "ref_id")
    semantic = cosine(F.col("a"), F.col("b"))
    return pairs.select("vec_id", "ref_id", F.round(fused_cosine(semantic, p), 6).alias("forma_cerrada"), F.round(cosine(fused(F.col("a"), p), fused(F.col("b"))), 6).alias("vectores"))


def benchmark_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-set similarity of the query set of documents with all benchmark items."""
    docs = table(spark, sf_dir, "documents").filter("doc_id % 100 = 0")
    return similarity.shared_tokens(docs, table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-set similarity of all documents with all benchmark items."""
    return similarity.shared_tokens(texts(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


def edit_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", F.round(edit_similarity(F.lower("p_name"), F.lower("p_type")), 6).alias("similitud"))


def learned_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of quality 1 for every document, from a model that all labelled ones train."""
    vectors = learned.gram_vectors(texts(spark, sf_dir, "documents"), "doc_id")
    return learned.scores(learned.fitted(vectors, table(spark, sf_dir, "labels"), "doc_id", "quality"), vectors, "doc_id")


def fingerprint_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many winnowed fingerprints documents share with benchmark items, from 20 on."""
    items = similarity.fingerprints(table(spark, sf_dir, "benchmark"), "item_id", k=12, window=8)
    docs = similarity.fingerprints(texts(spark, sf_dir, "documents"), "doc_id", k=12, window=8)
    return similarity.shared_fingerprints(docs, kept(items, "fingerprints"), "doc_id", "item_id").filter("n >= 20")


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents")
    logic = similarity.best_reference(docs, table(spark, sf_dir, "benchmark"))
    features = style_features(F.col("text"), F.col("runs"))
    style = docs.select("doc_id", "text", runs_of(F.col("text")).alias("runs")).select("doc_id", F.coalesce(synthetic_probability(features), F.lit(0.0)).alias("probabilidad"), style_weight(F.coalesce(F.length("text"), F.lit(0))).alias("peso"))
    return report.two_channel_report(logic, style, "doc_id")


def bimodal_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a submission, with its best benchmark item as reference."""
    return _report(spark, sf_dir).withColumn("referencia", F.col("referencia").cast("string"))


def integrity_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.findings(_report(spark, sf_dir), "doc_id")


def report_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(spark, sf_dir).groupBy("banda", "riesgo").agg(F.count("*").alias("n"))


def comparisons_by_problem(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    scored = _report(spark, sf_dir).join(docs, "doc_id").select(F.col("doc_id").alias("id"), "source", "similitud_global")
    return library.comparisons(scored, "source", "similitud_global")


def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.classification_metrics(table(spark, sf_dir, "labels"), "quality", "toxic")


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion_matrix(table(spark, sf_dir, "labels"), "quality", "toxic")


def human_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return evaluate.correlations(docs.select("lang", "n_chars", "quality"), "n_chars", "quality", "lang")


def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return evaluate.group_split(docs, "source")


def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.balanced(table(spark, sf_dir, "labels"), "quality", "doc_id")


def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.class_counts(table(spark, sf_dir, "labels"), "quality")


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("description"), F.col("p_brand").alias("category"))


def library_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.search(_cards(spark, sf_dir), "Brand#1")


def library_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.page(library.search(_cards(spark, sf_dir), "brand#1"), 2)


def library_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.page_count(library.search(_cards(spark, sf_dir), "brand#1"))


def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    percent = F.round(F.col("l_discount") * 1000, 4)
    marked = lines.select("l_orderkey", "l_linenumber", percent.alias("p"))
    return marked.select("l_orderkey", "l_linenumber", risk_band(F.col("p")).alias("riesgo"), is_significant(F.col("p")).alias("significativo"), F.round(gauge_offset(F.col("p")), 4).alias("arco"))


def tenant_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of one teacher's problems: nations belong to regions, customers' orders are reports."""
    customers = everyone(spark, sf_dir)
    problems = table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), F.col("n_regionkey").alias("docente_id"))
    submissions = customers.select(F.col("c_custkey").alias("id"), F.col("carpeta").alias("problema_id"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entrega_id"), F.col("o_totalprice").alias("total"))
    return report.of_teacher(orders, submissions, problems, F.lit(1))


def full_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of keys from report to teacher; a report's reference is code as well."""
    code = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("problema_id"), F.col("c_name").alias("autor_id"))
    problems = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("docente_id"), F.col("n_name").alias("titulo"))
    teachers = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("nombre"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entrega_id"), (F.col("o_custkey") - 1).alias("referencia_id"))
    return report.full_reports(orders, code, problems, teachers).select("id", "autor_entrega", "autor_referencia", "titulo", "nombre")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(table(spark, sf_dir, "events"))


_REPORT = f"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents), a AS (SELECT doc_id, token, count(*) AS n FROM words GROUP BY ALL),
an AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM a GROUP BY 1),
rwords AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM benchmark), b AS (SELECT item_id, token, count(*) AS n FROM rwords GROUP BY ALL),
bn AS (SELECT item_id, sqrt(sum(n * n)) AS norm FROM b GROUP BY 1), dots AS (SELECT doc_id, item_id, sum(a.n * b.n) AS dot FROM a JOIN b USING (token) GROUP BY ALL),
sims AS (SELECT doc_id, item_id, round(dot / (an.norm * bn.norm), 6) AS s FROM dots JOIN an USING (doc_id) JOIN bn USING (item_id)),
best AS (SELECT doc_id, item_id, s FROM sims QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, item_id) = 1),
style AS (SELECT doc_id, source, coalesce({_PROBABILITY}, 0) AS p, CASE WHEN coalesce(length(text), 0) < 200 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w FROM documents),
triple AS (SELECT doc_id, source, item_id AS referencia, coalesce(s, 0.0::DOUBLE) AS similitud_logica, round(p * w, 6) AS probabilidad_sintetica,
  round(coalesce(s, 0.0::DOUBLE) / sqrt(1 + round(p * w, 6) * round(p * w, 6)), 6) AS similitud_global FROM style LEFT JOIN best USING (doc_id)),
report AS (SELECT *, CASE WHEN similitud_logica >= 0.8 THEN 'high' WHEN similitud_logica >= 0.6 THEN 'moderate' WHEN similitud_logica >= 0.4 THEN 'low' ELSE 'dissimilar' END AS banda,
  CASE WHEN round(100 * similitud_global, 4) > 70 THEN 'ALTO' WHEN round(100 * similitud_global, 4) > 30 THEN 'MEDIO' ELSE 'BAJO' END AS riesgo, similitud_logica >= 0.8 AS prioridad FROM triple)
"""
_DOT = "list_sum(list_transform(list_zip(a, b), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_NORM = "sqrt(list_sum(list_transform({0}, lambda z: z::DOUBLE * z::DOUBLE)))"
_COSINE = f"{_DOT} / ({_NORM.format('a')} * {_NORM.format('b')})"
_PAIRS = "WITH q AS (SELECT vec_id, label, embedding AS a FROM embeddings WHERE vec_id % 100 = 0), v AS (SELECT vec_id AS ref_id, label, embedding AS b FROM embeddings)"
_TOP = _PAIRS + f", s AS (SELECT vec_id, ref_id, round({_COSINE}, 6) AS similitud, {_COSINE} AS raw FROM q JOIN v USING (label) WHERE vec_id <> ref_id), t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similitud DESC, ref_id) AS lugar FROM s QUALIFY lugar <= 5)"
_PART = "SELECT p_partkey AS id, p_name AS title, p_type AS description, p_brand AS category FROM part WHERE contains(lower(p_name), 'brand#1') OR contains(lower(p_type), 'brand#1') OR contains(lower(p_brand), 'brand#1')"
_GRAM = " || ".join(f"z[{k + 1}]" for k in range(12))
_GRAMS = ", ".join(f"c[{k + 1}:len(c) - {11 - k}]" for k in range(12))
_LEAST = ", ".join(f"z[{k + 1}]" for k in range(8))
_RUNS = ", ".join(f"h[{k + 1}:len(h) - {7 - k}]" for k in range(8))
_WINNOW = (
    "(SELECT {0}, unnest(list_distinct(CASE WHEN len(h) < 8 THEN [list_min(h)] ELSE list_transform(list_zip(" + _RUNS + "), lambda z: least(" + _LEAST + ")) END)) AS fingerprint FROM "
    "(SELECT {0}, list_transform(list_zip(" + _GRAMS + "), lambda z: ('0x' || substr(md5(" + _GRAM + "), 1, 12))::BIGINT) AS h FROM "
    "(SELECT {0}, string_split(regexp_replace(lower(text), '[ \\t\\n\\x{{0B}}\\f\\r]+', '', 'g'), '') AS c FROM {1}) WHERE len(c) >= 12))"
)

QUERIES = {
    f.__name__: f
    for f in (
        top_k_references, similar_above_threshold, similar_links, distances, fused_similarity, benchmark_jaccard, jaccard_pairs, edit_similarities, learned_style, fingerprint_matches, bimodal_report, integrity_indicators, report_bands,
        comparisons_by_problem, classification_metrics, confusion_matrix, human_correlation, group_split, balanced_sample, class_balance, library_search, library_page,
        library_pages, gauges, tenant_reports, full_reports, event_sessions,
    )
}
ORACLES = {
    "top_k_references": _TOP + " SELECT vec_id, ref_id, similitud, lugar FROM t",
    "similar_above_threshold": _PAIRS + f" SELECT vec_id, ref_id, s AS similitud, CASE WHEN s >= 0.8 THEN 'high' WHEN s >= 0.6 THEN 'moderate' WHEN s >= 0.4 THEN 'low' ELSE 'dissimilar' END AS banda "
    f"FROM (SELECT vec_id, ref_id, round({_COSINE}, 6) AS s FROM q JOIN v USING (label) WHERE vec_id <> ref_id) WHERE s >= 0.3",
    "distances": _PAIRS + f" SELECT vec_id, v.label, round(avg({_COSINE}), 5) AS coseno, round(avg(sqrt(list_sum(list_transform(list_zip(a, b), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))))), 5) AS distancia "
    "FROM q JOIN v ON vec_id <> ref_id GROUP BY ALL",
    "fused_similarity": _TOP + " SELECT vec_id, ref_id, round(raw / sqrt(1.25::DOUBLE), 6) AS forma_cerrada, round(raw / sqrt(1.25::DOUBLE), 6) AS vectores FROM t",
    "benchmark_jaccard": "WITH a AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents WHERE doc_id % 100 = 0), b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM benchmark), "
    "an AS (SELECT doc_id, count(*) AS n FROM a GROUP BY 1), bn AS (SELECT item_id, count(*) AS m FROM b GROUP BY 1), s AS (SELECT doc_id, item_id, count(*) AS c FROM a JOIN b USING (token) GROUP BY ALL) "
    "SELECT doc_id, item_id, round(c / (n + m - c)::DOUBLE, 6) AS jaccard FROM s JOIN an USING (doc_id) JOIN bn USING (item_id)",
    "similar_links": "WITH v AS (SELECT vec_id, label, embedding AS a FROM embeddings), w AS (SELECT vec_id AS ref_id, label, embedding AS b FROM embeddings), "
    f"s AS (SELECT vec_id, count(*) AS n FROM v JOIN w USING (label) WHERE vec_id <> ref_id AND round({_COSINE}, 6) >= 0.3 GROUP BY 1) "
    "SELECT vec_id, coalesce(any_value(n), 0) AS n_links FROM v LEFT JOIN s USING (vec_id) GROUP BY vec_id",
    "jaccard_pairs": "WITH a AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents), b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM benchmark), "
    "an AS (SELECT doc_id, count(*) AS n FROM a GROUP BY 1), bn AS (SELECT item_id, count(*) AS m FROM b GROUP BY 1), s AS (SELECT doc_id, item_id, count(*) AS c FROM a JOIN b USING (token) GROUP BY ALL) "
    "SELECT doc_id, item_id, round(c / (n + m - c)::DOUBLE, 6) AS jaccard FROM s JOIN an USING (doc_id) JOIN bn USING (item_id)",
    "edit_similarities": "SELECT p_partkey, round(1 - levenshtein(lower(p_name), lower(p_type)) / greatest(length(p_name), length(p_type))::DOUBLE, 6) AS similitud FROM part",
    "fingerprint_matches": f"SELECT doc_id, item_id, count(*) AS n FROM {_WINNOW.format('doc_id', 'documents')} JOIN {_WINNOW.format('item_id', 'benchmark')} USING (fingerprint) GROUP BY ALL HAVING count(*) >= 20",
    "bimodal_report": _REPORT + "SELECT doc_id, CAST(referencia AS VARCHAR) AS referencia, similitud_logica, probabilidad_sintetica, similitud_global, banda, riesgo, prioridad FROM report",
    "integrity_indicators": _REPORT + "SELECT doc_id, 'equivalencia_alta' AS tipo_hallazgo FROM report WHERE similitud_logica >= 0.8 UNION ALL SELECT doc_id, 'discrepancia_canales' FROM report WHERE similitud_logica >= 0.8 AND probabilidad_sintetica >= 0.5 "
    "UNION ALL SELECT doc_id, 'estilo_sintetico' FROM report WHERE probabilidad_sintetica >= 0.5 UNION ALL SELECT doc_id, 'sin_referencia' FROM report WHERE referencia IS NULL",
    "report_bands": _REPORT + "SELECT banda, riesgo, count(*) AS n FROM report GROUP BY ALL",
    "comparisons_by_problem": _REPORT + "SELECT source, count(*) AS activas, max(round(100 * similitud_global, 4)) AS mayor, count(*) FILTER (riesgo = 'ALTO') AS alto, count(*) FILTER (riesgo = 'MEDIO') AS medio, count(*) FILTER (riesgo = 'BAJO') AS bajo FROM report GROUP BY source",
    "classification_metrics": "WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality <> 1 AND toxic = 1) AS fp, count(*) FILTER (quality <> 1 AND toxic <> 1) AS tn, count(*) FILTER (quality = 1 AND toxic <> 1) AS fn FROM labels) "
    "SELECT tp, fp, tn, fn, round((tp + tn) / nullif(tp + fp + tn + fn, 0)::DOUBLE, 6) AS accuracy, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, "
    "round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6) AS f1, round(fp / nullif(fp + tn, 0)::DOUBLE, 6) AS false_positive_rate FROM c",
    "confusion_matrix": "SELECT quality AS truth, toxic AS predicted, count(*) AS n FROM labels GROUP BY ALL",
    "human_correlation": "WITH r AS (SELECT lang, n_chars, quality, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0::DOUBLE AS ra, "
    "rank() OVER (PARTITION BY lang ORDER BY quality) + (count(*) OVER (PARTITION BY lang, quality) - 1) / 2.0::DOUBLE AS rb FROM documents JOIN labels USING (doc_id) WHERE n_chars IS NOT NULL AND quality IS NOT NULL) "
    "SELECT lang, count(*) AS n, round(covar_pop(n_chars, quality) / nullif(stddev_pop(n_chars) * stddev_pop(quality), 0), 6) AS pearson, round(covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0), 6) AS spearman FROM r GROUP BY lang",
    "group_split": "SELECT doc_id, source, CASE WHEN b < 70 THEN 'train' WHEN b < 85 THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id, source, ('0x' || substr(md5(source), 1, 8))::BIGINT % 100 AS b FROM documents)",
    "balanced_sample": "SELECT doc_id, quality, toxic FROM labels WHERE quality IS NOT NULL QUALIFY row_number() OVER (PARTITION BY quality ORDER BY ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT, doc_id) "
    "<= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY quality))",
    "class_balance": "SELECT quality, count(*) AS n FROM labels GROUP BY quality",
    "library_search": _PART,
    "library_page": _PART + " ORDER BY id LIMIT 10 OFFSET 10",
    "library_pages": f"SELECT count(*) AS total, CAST(ceil(count(*) / 10.0) AS BIGINT) AS paginas, CASE WHEN count(*) > 10 THEN '1–10' END AS rango FROM ({_PART})",
    "gauges": "SELECT l_orderkey, l_linenumber, CASE WHEN p > 70 THEN 'ALTO' WHEN p > 30 THEN 'MEDIO' ELSE 'BAJO' END AS riesgo, p > 50 AS significativo, round(2 * pi() * 90 - p / 100 * (2 * pi() * 90), 4) AS arco FROM (SELECT *, round(l_discount * 1000, 4) AS p FROM lineitem)",
    "tenant_reports": "SELECT o_orderkey AS id, o_custkey AS entrega_id, o_totalprice AS total FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1)",
    "full_reports": "SELECT o_orderkey AS id, c.c_name AS autor_entrega, r.c_name AS autor_referencia, n_name AS titulo, r_name AS nombre FROM orders JOIN customer c ON o_custkey = c.c_custkey LEFT JOIN customer r ON o_custkey - 1 = r.c_custkey "
    "JOIN nation ON c.c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "event_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
    "s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS inicio, max(ts) + INTERVAL 30 MINUTE AS fin, count(*) AS n FROM s GROUP BY user_id, k",
}

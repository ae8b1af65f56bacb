"""Queries on prompts, answers, code and style."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.functions import text as T
from cotejo.functions.style import char_ngrams, runs_of, style_features, synthetic_probability
from cotejo.operators.clones import equal_contents
from cotejo.plans._tables import table, texts


def parse_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in both forms, made of conversations."""
    talk = table(spark, sf_dir, "conversations")
    piped = F.concat(F.lit(" Enunciado: "), "text", F.lit(" | Lenguaje: "), "role", F.lit("\n"))
    by_line = F.concat(F.lit("Lenguaje: "), "role", F.lit("\nEnunciado: "), "text")
    rows = talk.select("conv_id", "turn", F.explode(F.array(F.struct(F.lit("piped").alias("form"), piped.alias("a")), F.struct(F.lit("lines").alias("form"), by_line.alias("a")))).alias("x"))
    enunciado, lenguaje = T.parse_statement(F.col("x.a"))
    return rows.select("conv_id", "turn", "x.form", enunciado.alias("enunciado"), lenguaje.alias("lenguaje"))


def extract_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations")
    fenced = F.concat(F.lit("Code:\n```cpp\n"), "text", F.lit("\n```\nend"))
    return talk.select("conv_id", "turn", T.fenced_code(fenced).alias("codigo"), T.fenced_code(fenced, compat=True).alias("codigo_compat"))


def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    name = F.concat(F.lit("referencia_v"), F.col("o_orderkey") % 7, F.lit("_"), "o_orderpriority", F.lit(".c"))
    return orders.select("o_orderkey", T.version_of(name).cast("long").alias("version"), T.model_of(name).alias("modelo"))


def message_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    system, user = T.flattened(F.col("messages"))
    return talk.groupBy("conv_id").agg(turns.alias("messages")).select("conv_id", system.alias("system"), user.alias("user"))


def prompt_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(T.statement_prompt(F.col("text"), F.lit(None).cast("string")), 256).alias("prompt_hash"))


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = texts(spark, sf_dir, "pages")
    return pages.select("page_id", F.sha2(F.coalesce(T.normalized_layout(F.col("html")), F.lit("")), 256).alias("layout_hash"), T.is_recoverable(F.col("html")).alias("recuperable"))


def style_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents").select("doc_id", "text", runs_of(F.col("text")).alias("runs"))
    features = style_features(F.col("text"), F.col("runs"))
    wanted = ("n_chars", "n_lines", "n_keywords", "n_operators", "mean_token", "share_if", "share_for", "space_indent", "tab_indent", "blank_lines", "same_line_braces", "own_line_braces", "comment_density", "camel_names", "snake_names")
    return docs.select("doc_id", *[features[n].alias(n) for n in wanted])


def synthetic_probability_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents").select("doc_id", "text", runs_of(F.col("text")).alias("runs"))
    return docs.select("doc_id", synthetic_probability(style_features(F.col("text"), F.col("runs"))).alias("probabilidad"))


def char_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents")
    chars = docs.select("lang", F.explode(F.split("text", "")).alias("c")).filter("c <> ''")
    return chars.groupBy("lang", "c").agg(F.count("*").alias("n"))


def top_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigrams of characters that stand in a tenth of a language's documents or more: pooled presence."""
    docs = texts(spark, sf_dir, "documents")
    grams = docs.select("lang", F.explode(F.array_distinct(char_ngrams(F.lower("text"), 3))).alias("gram"))
    counts = grams.groupBy("lang", "gram").agg(F.count("*").alias("docs"))
    sizes = docs.groupBy("lang").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(sizes), "lang").filter("10 * docs >= n").select("lang", "gram", "docs")


def content_hash_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equal_contents(table(spark, sf_dir, "documents"), "doc_id")


_STRIP = r"regexp_replace({}, '^[\s\x{{0B}}\x{{85}}\p{{Z}}]+|[\s\x{{0B}}\x{{85}}\p{{Z}}]+$', '', 'g')"
_LITERAL = r'''("(?:\\.|[^"\\\n])*"|''' + r"""\''(?:\\.|[^\''\\\n])*\'')""".replace("\\''", "''")


def _strip(x: str) -> str:
    return _STRIP.format(x)


def _without_comments(x: str) -> str:
    return f"regexp_replace({x}, '{_LITERAL}|//[^\\n]*|/\\*(?s:.*?)\\*/', '\\1', 'g')"


def _count(pattern: str) -> str:
    return f"CAST(len(regexp_extract_all(text, '{pattern}')) AS BIGINT)"


def _ratio(a: str, b: str) -> str:
    return f"round(CASE WHEN {b} = 0 THEN 0 ELSE ({a})::DOUBLE / ({b})::DOUBLE END, 6)"


_LINES = r"string_split(text, chr(10))"
_BLANK = f"len(list_filter({_LINES}, lambda x: trim(x) = ''))"
_CONTROL = " + ".join(_count(rf"\b{c}\b") for c in ("if", "for", "while", "switch"))
_MEAN_TOKEN = _ratio(r"coalesce(list_sum(list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'), lambda w: length(w))), 0)", r"len(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'))")
_COMMENTS = _ratio(f"length(text) - length({_without_comments('text')})", "length(text)")
_BLANKS = _ratio(_BLANK, f"len({_LINES})")
_OWN, _TABS = _count(r"\n[ \t]*\{"), f"CAST(len(list_filter({_LINES}, lambda x: starts_with(x, chr(9)))) AS BIGINT)"
_PROBABILITY = f"round(1 / (1 + exp(-(-1.0::DOUBLE + 3.0::DOUBLE * {_COMMENTS} + 2.0::DOUBLE * {_BLANKS} + 0.1::DOUBLE * {_MEAN_TOKEN} + -0.05::DOUBLE * {_OWN} + -0.02::DOUBLE * {_TABS}))), 6)"

QUERIES = {
    f.__name__: f
    for f in (
        parse_statement, extract_fence, model_names, message_flatten, prompt_truncate, normalize_text, style_table,
        synthetic_probability_table, char_profile, top_ngrams, content_hash_lookup,
    )
}
ORACLES = {
    "parse_statement": "SELECT conv_id, turn, 'piped' AS form, " + _strip("replace(string_split(t, '|')[1], 'Enunciado:', '')") + " AS enunciado, " + _strip("replace(string_split(t, '|')[2], 'Lenguaje:', '')") + " AS lenguaje "
    "FROM (SELECT *, " + _strip("' Enunciado: ' || text || ' | Lenguaje: ' || role || chr(10)") + " AS t FROM conversations) UNION ALL "
    "SELECT conv_id, turn, 'lines', CASE WHEN contains(t, '|') THEN " + _strip("replace(string_split(t, '|')[1], 'Enunciado:', '')") + " ELSE coalesce(nullif(" + _strip("replace(list_filter(string_split(t, chr(10)), lambda x: starts_with(x, 'Enunciado:'))[-1], 'Enunciado:', '')") + ", ''), left(t, 100)) END, "
    "CASE WHEN contains(t, '|') THEN " + _strip("replace(string_split(t, '|')[2], 'Lenguaje:', '')") + " ELSE " + _strip("replace(list_filter(string_split(t, chr(10)), lambda x: starts_with(x, 'Lenguaje:'))[-1], 'Lenguaje:', '')") + " END "
    "FROM (SELECT *, " + _strip("'Lenguaje: ' || role || chr(10) || 'Enunciado: ' || text") + " AS t FROM conversations)",
    "extract_fence": "SELECT conv_id, turn, " + _strip("regexp_replace(split_part(t, '```', 2), '^cpp', '')") + " AS codigo, " + _strip("split_part(split_part(t, '```c', 2), '```', 1)") + " AS codigo_compat "
    "FROM (SELECT *, 'Code:' || chr(10) || '```cpp' || chr(10) || text || chr(10) || '```' || chr(10) || 'end' AS t FROM conversations)",
    "model_names": "SELECT o_orderkey, o_orderkey % 7 AS version, string_split(o_orderpriority, '_')[-1] AS modelo FROM orders",
    "message_flatten": "SELECT conv_id, arg_max(text, turn) FILTER (role = 'system') AS system, arg_max(text, turn) FILTER (role = 'user') AS user FROM conversations GROUP BY conv_id",
    "prompt_truncate": "SELECT doc_id, sha256('Analiza estos códigos de estudiantes que resuelven el mismo problema.' || chr(10) || 'Infiere cuál es el enunciado/tarea original basándote en el código.' || chr(10) "
    "|| 'Solo responde con el enunciado inferred y el lenguaje de programación.' || chr(10) || chr(10) || 'Código 1:' || chr(10) || left(text, 2000) || chr(10) || chr(10) || 'Código 2:' || chr(10) "
    "|| chr(10) || chr(10) || 'Responde en formato: \"Enunciado: X | Lenguaje: Y\"' || chr(10)) AS prompt_hash FROM documents",
    "normalize_text": "SELECT page_id, sha256(coalesce(" + _strip(f"regexp_replace({_without_comments('html')}, '[ \\t\\n\\x{{0B}}\\f\\r]+', ' ', 'g')") + ", '')) AS layout_hash, "
    + _strip(_without_comments("html")) + " <> '' AND len(regexp_extract_all(" + _without_comments("html") + ", '\\{')) = len(regexp_extract_all(" + _without_comments("html") + ", '\\}')) AS recuperable FROM pages",
    "style_table": "SELECT doc_id, length(text) AS n_chars, CAST(len(" + _LINES + ") AS BIGINT) AS n_lines, " + _count(rf"\b(?:{'|'.join(T.KEYWORDS)})\b") + " AS n_keywords, " + _count(r"[-+*/%=<>!&|^~]") + f" AS n_operators, {_MEAN_TOKEN} AS mean_token, "
    + _ratio(_count(r"\bif\b"), _CONTROL).replace("= 0", "= 0") .replace(f"CASE WHEN {_CONTROL} = 0", f"CASE WHEN ({_CONTROL}) = 0") + " AS share_if, "
    + _ratio(_count(r"\bfor\b"), _CONTROL).replace(f"CASE WHEN {_CONTROL} = 0", f"CASE WHEN ({_CONTROL}) = 0") + " AS share_for, "
    + f"CAST(len(list_filter({_LINES}, lambda x: starts_with(x, ' '))) AS BIGINT) AS space_indent, {_TABS} AS tab_indent, {_BLANKS} AS blank_lines, " + _count(r"\)[ \t]*\{") + f" AS same_line_braces, {_OWN} AS own_line_braces, {_COMMENTS} AS comment_density, "
    + _count(r"\b[a-z]+(?:[A-Z][a-z0-9]*)+\b") + " AS camel_names, " + _count(r"\b[a-z0-9]+(?:_[a-z0-9]+)+\b") + " AS snake_names FROM documents",
    "synthetic_probability_table": f"SELECT doc_id, {_PROBABILITY} AS probabilidad FROM documents",
    "char_profile": "SELECT lang, c, count(*) AS n FROM (SELECT lang, unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY ALL",
    "top_ngrams": "WITH t AS (SELECT lang, string_split(lower(text), '') AS c FROM documents WHERE length(text) >= 3), g AS (SELECT lang, unnest(list_distinct(list_transform(list_zip(c[1:-3], c[2:-2], c[3:]), lambda z: z[1] || z[2] || z[3]))) AS gram FROM t), "
    "c AS (SELECT lang, gram, count(*) AS docs FROM g GROUP BY ALL) SELECT lang, gram, docs FROM c JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) USING (lang) WHERE 10 * docs >= n",
    "content_hash_lookup": "SELECT doc_id, sha256(coalesce(text, '')) AS hash, count(*) OVER (PARTITION BY sha256(coalesce(text, ''))) AS n, min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS first FROM documents",
}

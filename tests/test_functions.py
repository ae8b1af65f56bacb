"""Functions on small values, and their properties."""

import math

import pytest
from pyspark.sql import functions as F

from cotejo.functions import bands, style, vectors
from cotejo.functions import text as T
from cotejo.operators import clones, evaluate, flow, library, report, similarity, tasks
from cotejo.streaming import ingest


def values(spark, column, rows, kind="string"):
    return [tuple(r) if len(r) > 1 else r[0] for r in spark.createDataFrame([(x,) for x in rows], f"x {kind}").select(*(column if isinstance(column, tuple | list) else [column])).collect()]


def test_parse_statement(spark):
    cases = {
        "Enunciado: X | Lenguaje: C": ("X", "C"),
        "  a|b|c ": ("a", "b"),
        "Enunciado: foo\nLenguaje: C++": ("foo", "C++"),
        "Enunciado: a\nEnunciado: b": ("b", "C"),
        "y" * 200: ("y" * 100, "C"),
        "": ("", "C"),
        "Enunciado:   \nLenguaje:": ("Enunciado:   \nLenguaje:", ""),
    }
    assert values(spark, T.parse_statement(F.col("x")), cases) == list(cases.values())


def test_fences(spark):
    cases = {
        "```c\nint x;\n```": ("int x;", "int x;"),
        "```cpp\nint main(){}\n```": ("int main(){}", "pp\nint main(){}"),
        "```C\nint x;\n```": ("int x;", "C\nint x;"),
        "```\nint x;\n```": ("int x;", "int x;"),
        " int x; ": ("int x;", "int x;"),
    }
    assert values(spark, (T.fenced_code(F.col("x")), T.fenced_code(F.col("x"), compat=True)), cases) == list(cases.values())


def test_normalising(spark):
    code = 'int f(int n) { // line\n  char *s = "//no /* x */"; /* block\n block */ return n+1; }'
    layout, renamed = values(spark, (T.normalized_layout(F.col("x")), T.normalized(F.col("x"))), [code])[0]
    assert layout == 'int f(int n) { char *s = "//no /* x */"; return n+1; }'
    assert renamed == 'int ID(int ID) { char *ID = "//no /* x */"; return ID+1; }'
    assert values(spark, T.is_recoverable(F.col("x")), [code, "{", "// only", ""]) == [True, False, False, False]


def test_clones(spark):
    rows = [(1, "int a; // one"), (2, "int   a;"), (3, "int b;"), (4, "float b;")]
    got = clones.clone_classes(spark.createDataFrame(rows, "id int, contenido string"), "id").collect()
    assert {r.id: (r.type_1, r.type_2) for r in got} == {1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (4, 4)}


def test_errors_and_waits(spark):
    assert values(spark, T.is_retryable(F.col("x")), ["HTTP 429", "503 x", "bad key", None]) == [True, True, False, None]
    assert values(spark, T.retry_wait(F.col("x")), range(6), "int") == [30, 60, 120, 240, 480, 960]


def test_messages(spark):
    talk = [[("system", "s1"), ("user", "u1"), ("assistant", "a"), ("user", "u2")], [("user", "u")], []]
    assert values(spark, T.flattened(F.col("x")), talk, "array<struct<role:string,content:string>>") == [("s1", "u2"), (None, "u"), (None, None)]


def test_style(spark):
    code = "int main() {\n\tfor (;;) { if (x) { y_z = aB; } }\n\n}\n"
    wanted = ("n_lines", "tab_indent", "mean_nesting", "n_functions", "snake_names", "camel_names", "same_line_braces")
    features = style.style_features(F.col("x"))
    got = dict(zip(wanted, values(spark, [features[n] for n in wanted], [code])[0], strict=True))
    assert got == {"n_lines": 5, "tab_indent": 1, "mean_nesting": 2.0, "n_functions": 1, "snake_names": 1, "camel_names": 1, "same_line_braces": 3}
    assert values(spark, style.char_ngrams(F.col("x"), 3), ["añbc", "ab", ""]) == [["añb", "ñbc"], [], []]
    assert values(spark, style.char_codes(F.col("x"), "ab"), ["abz"]) == [[1, 2, 0]]


def test_vectors(spark):
    rows = [([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [1.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()
    assert [got[0][0], got[1][0], got[2][0]] == [pytest.approx(0.96), None, None]
    for p in (0.0, 0.3, 1.0):
        long = vectors.cosine(vectors.fused(F.col("a"), F.lit(p)), vectors.fused(F.col("b")))
        short = vectors.fused_cosine(vectors.cosine(F.col("a"), F.col("b")), F.lit(p))
        row = df.limit(1).select(long, short).first()
        assert row[0] == pytest.approx(row[1]) and row[1] == pytest.approx(0.96 / math.sqrt(1 + p * p))


def test_bands(spark):
    assert values(spark, bands.semantic_band(F.col("x")), [0.8, 0.79, 0.6, 0.4, 0.39, -1.0, None], "double") == ["high", "moderate", "moderate", "low", "dissimilar", "dissimilar", None]
    assert values(spark, bands.risk_band(F.col("x")), [70.0, 70.1, 30.0, 30.1], "double") == ["MEDIO", "ALTO", "BAJO", "MEDIO"]
    assert values(spark, bands.variations(F.col("x")), [0, 3, 11, None], "int") == [1, 3, 10, 3]
    assert values(spark, bands.gauge_offset(F.col("x")), [100.0], "double") == [pytest.approx(0)]


def test_search_in_blocks_of_queries(spark, monkeypatch):
    rows = [(i, i % 2, [float(i), 1.0, 0.5]) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    queries = table.filter("vec_id % 10 = 0")
    def run():
        return sorted(tuple(r) for r in similarity.vector_search(queries, table, 3).select("vec_id", "ref_id", "similitud", "lugar").collect())

    def means():
        return sorted(tuple(r) for r in similarity.mean_distances(queries, table).collect())

    fast, distances = run(), means()
    monkeypatch.setattr(similarity, "KERNEL_CELLS", 8)
    assert len(similarity._query_blocks(queries)) == 3
    assert run() == fast and len(fast) == 12
    assert means() == distances and len(distances) == 8
    own = [r for r in rows if r[1] == 1]
    wanted = sum(math.dist(rows[10][2], r[2]) for r in own) / len(own)
    assert [d for q, label, _, d in distances if (q, label) == (10, 1)] == [pytest.approx(wanted, abs=1e-5)]


def test_links_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 4))
    rows = [(k, k % 2, x[k].tolist()) for k in range(40)] + [(40, None, x[0].tolist()), (41, 0, None), (42, 0, [0.0] * 4), (43, 1, [1.0])]
    got = similarity.link_counts(spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>"), 0.3, block=6).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = (unit @ unit.T).round(6) >= 0.3
    want = {k: sum(bool(close[k, j]) for j in range(40) if j != k and (j - k) % 2 == 0) for k in range(40)}
    assert {r.vec_id: r.n_links for r in got} == want | {40: 0, 41: 0, 42: 0, 43: 0}


def test_best_reference_on_both_paths(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "gamma"), (3, None), (4, ""), (5, "Beta ALPHA")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "alpha beta"), (9, "beta beta alpha"), (8, "alpha beta")], "item_id long, text string")
    def run():
        return {r.doc_id: (r.referencia, r.similitud) for r in similarity.best_reference(docs, items).collect()}

    fast = run()
    assert fast == {1: (9, 1.0), 2: (None, 0.0), 3: (None, 0.0), 4: (None, 0.0), 5: (7, 1.0)}
    monkeypatch.setattr(similarity, "KERNEL_CELLS", 1)
    assert run() == fast
    assert set(similarity.best_reference(docs, items.limit(0)).select("similitud").distinct().toPandas().similitud) == {0.0}


def test_report(spark):
    logic = spark.createDataFrame([(1, 5, 0.9), (2, None, 0.0)], "doc_id long, referencia long, similitud double")
    marks = spark.createDataFrame([(1, 0.8, 1.0), (2, 0.2, 0.5)], "doc_id long, probabilidad double, peso double")
    found = report.two_channel_report(logic, marks, "doc_id")
    assert {(r.doc_id, r.tipo_hallazgo) for r in report.findings(found, "doc_id").collect()} == {(1, "equivalencia_alta"), (1, "discrepancia_canales"), (1, "estilo_sintetico"), (2, "sin_referencia")}


def test_split_never_leaks(spark):
    rows = spark.range(2000).select(F.col("id"), (F.col("id") % 97).cast("string").alias("g"))
    split = evaluate.group_split(rows, "g")
    assert split.groupBy("g").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0 and split.count() == 2000


def test_balance(spark):
    rows = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 30, 1).otherwise(0).alias("y"))
    got = {r.y: r.n for r in evaluate.class_counts(evaluate.balanced(rows, "y", "id"), "y").collect()}
    assert got == {0: 30, 1: 30}


def test_library(spark):
    cards = spark.createDataFrame([(1, "Uno", "x", "c"), (2, "Dos", "y_%", "c")], "id int, title string, category string, description string")
    many = library.sample_cards(cards, 25)
    assert many.count() == 25 and library.page(many, 3).count() == 5
    assert library.search(cards, "_%").count() == 1 and library.search(cards, "").count() == 2 and library.search(cards, "UNO").count() == 1


def test_answers(spark):
    key = "curso string, carpeta string, subcarpeta string"
    items = spark.createDataFrame([("A", "B", "C", "sum")], f"{key}, enunciado string")
    originals = spark.createDataFrame([("A", "B", "C", "int x;")], f"{key}, contenido string")
    made = tasks.generation_tasks(items, originals, spark.createDataFrame([("m",)], "nombre string"), 3)
    assert sorted(r.archivo for r in made.collect()) == ["referencia_v1_m.c", "referencia_v2_m.c", "referencia_v3_m.c"]
    answers = spark.createDataFrame([(1, "```c\nint y;\n```", None), (2, None, "429"), (3, None, "boom")], "version int, answer string, error string")
    done = tasks.answered(made, answers, ["version"])
    assert {r.version: r.state for r in done.collect()} == {1: "done", 2: "retry", 3: "failed"}
    assert [r.codigo for r in tasks.references_of(done).collect()] == ["int y;"]


def test_flow(spark):
    code = spark.createDataFrame([(1, "int a = 1; b = a + 2; a++; return a + b; // a")], "id int, contenido string")
    got = [(r.name, r.src, r.dst) for r in flow.edges(code, "id").orderBy("src", "dst").collect()]
    assert [g[0] for g in got] == ["a", "b", "a"] and all(s < d for _, s, d in got)


def test_stream(spark, tmp_path):
    rows = [(1, 1, "x", False, "c", "int a;"), (2, 1, "y", False, "c", "int  a; // b")]
    spark.createDataFrame(rows, ingest.CODIGO_FUENTE).write.parquet(str(tmp_path / "in"))
    seen = []
    query = ingest.process(ingest.arriving_code(spark, str(tmp_path / "in")), str(tmp_path / "cp"), lambda df, _: seen.extend(r.hash for r in df.collect()))
    query.awaitTermination()
    assert len(seen) == 2 and len(set(seen)) == 1


def test_correlations_of_constant_and_single_rows(spark):
    rows = [("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 4.0), ("b", 1, 5.0), ("b", 2, 5.0), ("c", 1, 1.0), (None, 1, 1.0), (None, 2, 0.0), ("d", None, 1.0)]
    got = {r.g: (r.n, r.pearson, r.spearman) for r in evaluate.correlations(spark.createDataFrame(rows, "g string, x int, y double"), "x", "y", "g").collect()}
    assert got == {"a": (3, 0.981981, 1.0), "b": (2, None, None), "c": (1, None, None), None: (2, -1.0, -1.0)}


def test_clone_types(spark):
    from pyspark.sql import functions as F

    rows = [("int a; // x", "int  a;", 1.0, 1.0), ("int a;", "int b;", 0.3, 0.2), ("int a;", "float b; c", 0.7, 0.1), ("int a;", "while (x) y", 0.1, 0.9), ("int a;", "x", 0.0, 0.0)]
    got = spark.createDataFrame(rows, "a string, b string, j double, c double").select(clones.clone_type(F.col("a"), F.col("b"), F.col("j"), F.col("c")).alias("t")).collect()
    assert [r.t for r in got] == ["I", "II", "III", "IV", None]


def test_generators(spark):
    from cotejo.operators import generators

    tasks_ = spark.createDataFrame([("t1", "uno"), ("t2", "dos")], "task string, prompt string")
    generators.register_generator("table", generators.from_table(spark.createDataFrame([("t1", "x", None)], generators.ANSWERS)))
    assert [tuple(r) for r in generators.generator("table")(tasks_).collect()] == [("t1", "x", None)]
    generators.register_generator("upper", generators.calling(lambda prompts: [(p.upper(), None) for p in prompts]))
    assert {r.task: r.answer for r in generators.generator("upper")(tasks_).collect()} == {"t1": "UNO", "t2": "DOS"}

    def busy(prompts):
        raise RuntimeError("429 busy")

    failed = generators.calling(busy)(tasks_)
    assert {r.state for r in tasks.answered(tasks_, failed).collect()} == {"retry"}
    with pytest.raises(KeyError, match="upper"):
        generators.generator("other")
    generators.register_featurizer("length", lambda code: code.select("key", F.length("text").cast("double").alias("n")))
    assert generators.featurizer("length")(spark.createDataFrame([("k", "abc")], "key string, text string")).first().n == 3.0


def test_gram_vectors(spark, monkeypatch):
    """The vectors are those of HashingTF on the runs of characters, in parts of any size."""
    from pyspark.ml.feature import HashingTF

    from cotejo.functions.style import char_ngrams
    from cotejo.operators import learned

    monkeypatch.setattr(learned, "CHARS", 40)
    texts = [None, "", "ab", "abc", "The the THE", "é𝄞€ ñandú\n\té𝄞€", "x" * 100, "int main() { return 0; }"]
    rows = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "id string, text string").repartition(2)
    for n, features in ((3, 1 << 12), (1, 7), (5, 100)):
        grams = rows.select("id", char_ngrams(F.coalesce(F.lower("text"), F.lit("")), n).alias("grams"))
        want = {r.id: r.v for r in HashingTF(inputCol="grams", outputCol="v", numFeatures=features).transform(grams).collect()}
        assert {r.id: r.features for r in learned.gram_vectors(rows, "id", n=n, features=features).collect()} == want

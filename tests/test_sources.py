"""Readers and writers on files of their own shape."""

import json
import os
import random
from collections import Counter

from pyspark.sql import functions as F

from cotejo.operators import coverage, tasks
from cotejo.sources import corpus, sinks, statements, traces, tree
from cotejo.sources.schemas import KEY


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())


def test_corpus_scan(spark, tmp_path):
    root = tmp_path / "src"
    put(root / "A2016/Z1/Z1/b.cpp", "int b;")
    put(root / "A2016/Z1/Z1/a.c", b"int a\xff;")
    put(root / "A2016/Z1/Z2/only.h", "x")
    put(root / "A2016/Z1/stray.c", "x")
    put(root / "A2016/Z10/Z1/UP.C", "x")
    (root / "A2016/Z2/empty").mkdir(parents=True)
    files = corpus.scan_files(spark, str(root))
    got = {(r.subcarpeta, r.archivo, r.ext, r.contenido) for r in files.collect()}
    assert got == {("Z1", "a.c", "c", "int a;"), ("Z1", "b.cpp", "cpp", "int b;")}
    listed = spark.createDataFrame([(str(p),) for p in root.glob("*/*/*") if p.is_dir()], "path string")
    inventory = corpus.problem_inventory(files, listed)
    assert {tuple(r) for r in inventory.collect()} == {("A2016", "Z1", "Z1", 2), ("A2016", "Z1", "Z2", 0), ("A2016", "Z10", "Z1", 0), ("A2016", "Z2", "empty", 0)}
    assert [r.carpeta for r in inventory.select("carpeta").distinct().orderBy("carpeta").collect()] == ["Z1", "Z10", "Z2"]
    assert [r.archivo for r in tasks.first_files(files, 1).collect()] == ["a.c"]
    prompts = tasks.inference_tasks(inventory, files).collect()
    assert len(prompts) == 1 and prompts[0].prompt.index("int a;") < prompts[0].prompt.index("int b;")


def test_references(spark, tmp_path):
    for name in ("referencia_v1_gpt-4o-mini.c", "referencia_v2_gemini-1.5-pro.c", "referencia_v3_my_model.c", "referencia_v4.c", "referencia_v1_x.cpp"):
        put(tmp_path / "out/A/Z1/Z1" / name, "x")
    got = {(r.version, r.modelo) for r in corpus.scan_references(spark, str(tmp_path / "out")).collect()}
    assert got == {(1, "gpt-4o-mini"), (2, "gemini-1.5-pro"), (3, "model")}
    assert corpus.scan_references(spark, str(tmp_path / "missing")).count() == 0


def test_uploads(spark):
    rows = spark.createDataFrame([("a.C", 10), ("a.cpp", 5 * 1024 * 1024 + 1), ("a.py", 1), ("b.cpp", 1)], "archivo string, bytes long")
    assert {r.archivo for r in corpus.acceptable_uploads(rows).collect()} == {"a.C", "b.cpp"}


def test_statements(spark, tmp_path):
    put(tmp_path / "e.csv", 'curso,carpeta,subcarpeta,enunciado,lenguaje\nA,Z1,Z1,"Uno, dos",C\nA,Z1,Z2,"línea\nnueva",C\nA,Z1,Z1,último,C++\n')
    read = statements.read_statements(spark, str(tmp_path / "e.csv"))
    last = statements.last_wins(read, KEY)
    got = [(r.subcarpeta, r.enunciado, r.lenguaje) for r in last.orderBy("pos").collect()]
    assert got == [("Z1", "último", "C++"), ("Z2", "línea\nnueva", "C")]
    assert statements.limited(last, 1).count() == 1 and statements.limited(last, 0).count() == 2


def test_checkpoint(spark, tmp_path):
    put(tmp_path / "c.json", json.dumps([["A", "Z1", "Z1"], ["A", "Z1", "Z2"]]))
    put(tmp_path / "bad.json", "{oops")
    assert statements.read_checkpoint(spark, str(tmp_path / "c.json")).count() == 2
    assert statements.read_checkpoint(spark, str(tmp_path / "bad.json")).count() == 0
    assert statements.read_checkpoint(spark, str(tmp_path / "none.json")).count() == 0


def test_metadata(spark, tmp_path):
    item = {"asignacion": "Z1", "enunciado": "e", "codigo_original": "c", "modelo": "m", "version": 1}
    put(tmp_path / "m.json", json.dumps({"references": [item | {"timestamp": "2026-04-16T10:30:00"}, item | {"timestamp": "2026-04-17T10:30:00", "enunciado": "f"}]}))
    read = statements.read_metadata(spark, str(tmp_path / "m.json"))
    assert read.count() == 2
    assert [r.enunciado for r in statements.latest_metadata(read).collect()] == ["f"]


def test_ground_truth(spark, tmp_path):
    put(tmp_path / "g.txt", "- A2016/Z1/Z1\nstudent2956\nstudent7386,student5378,student9538\nstudent6018\n")
    truth = traces.read_ground_truth(spark, str(tmp_path / "g.txt"))
    assert truth.count() == 5 and truth.select("group_id").distinct().count() == 3
    pairs = traces.guilty_pairs(truth).collect()
    assert len(pairs) == 3 and all(p.group_id == 2 and p.student_a < p.student_b for p in pairs)


def test_traces(spark):
    event = {"time": 1460000000, "text": "modified", "filename": "a.c", "diff": "[1]"}
    path = {"total_time": 5, "builds": 1, "builds_succeeded": 2, "testings": 1, "last_test_results": "5/10", "last_revision": 1, "entries": ["a"], "events": [event]}
    text = json.dumps({"Z1/a.c": path, "Z1/b.c": path | {"events": [], "last_test_results": ""}})
    read = traces.parse_traces(spark.createDataFrame([("s1", text)], "file string, value string"))
    assert read.count() == 2 and traces.trace_events(read).first().at.year == 2016
    activity = traces.trace_activity(read).first()
    assert (activity.builds, activity.builds_succeeded, activity.passed) == (2, 4, 0.5)
    odd = spark.createDataFrame([("10/10",), ("0/0",), ("x",), (None,)], "t string")
    assert [r[0] for r in odd.select(traces.ratio(F.col("t"))).collect()] == [1.0, None, None, None]


def test_sinks(spark, tmp_path):
    problems = spark.createDataFrame([("A", "Z2", "1", 3), ("A", "Z1", "1", 0), ("A", "Z10", "1", 1)], "curso string, carpeta string, subcarpeta string, num_archivos long")
    references = spark.createDataFrame([("A", "Z1", "1", 1, "m"), ("A", "Z9", "1", 1, "m")], "curso string, carpeta string, subcarpeta string, version int, modelo string")
    sinks.write_coverage_csv(coverage.export_rows(problems, references), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()
    assert text == ["curso,carpeta,subcarpeta,archivos_originales,referencias_ia", "A,Z1,1,0,1", "A,Z10,1,1,0", "A,Z2,1,3,0"]
    sinks.write_coverage_json(coverage.nested_document(problems, references), str(tmp_path / "json"))
    document = json.loads(next((tmp_path / "json").glob("*.json")).read_text())
    assert document["dataset"]["total_problemas"] == 3 and document["referencias"] == {"total": 2, "por_problema": [{"problema": "A/Z1/1", "total": 1, "modelos": {"m": 1}}]}
    assert coverage.totals(problems, references).first().referencias_huerfanas == 1
    vectors = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "id string, embedding array<double>")
    sinks.upsert_vectors(vectors, str(tmp_path / "v"), 1)
    sinks.upsert_vectors(vectors.filter("id = 'a'").withColumn("embedding", F.array(F.lit(9.0))), str(tmp_path / "v"), 2)
    assert {r.id: r.embedding for r in sinks.current_vectors(spark.read.parquet(str(tmp_path / "v"))).collect()} == {"a": [9.0], "b": [2.0]}
    sinks.append_completed(problems, str(tmp_path / "done"))
    assert coverage.pending(problems, spark.read.parquet(str(tmp_path / "done"))).count() == 0


def test_commands(spark, tmp_path, capsys):
    """From a corpus to statements, references as files, and the coverage of them."""
    from cotejo.__main__ import main

    put(tmp_path / "src/A/Z1/P1/a.c", "int a;")
    put(tmp_path / "src/A/Z1/P2/b.cpp", "int b;")
    at = lambda name: str(tmp_path / name)
    main(["statements", "--dataset-path", at("src"), "--tasks", at("tasks"), "--checkpoint", at("done")], spark)
    asked = spark.read.parquet(at("tasks"))
    assert asked.count() == 2
    asked.select("task", F.lit("Enunciado: suma | Lenguaje: C").alias("answer"), F.lit(None).cast("string").alias("error")).filter("subcarpeta = 'P1'").write.parquet(at("answers"))
    main(["statements", "--dataset-path", at("src"), "--tasks", at("tasks"), "--answers", at("answers"), "--output", at("e"), "--checkpoint", at("done")], spark)
    assert [tuple(r)[:5] for r in statements.read_statements(spark, at("e")).collect()] == [("A", "Z1", "P1", "suma", "C")]
    main(["statements", "--dataset-path", at("src"), "--tasks", at("again"), "--checkpoint", at("done")], spark)
    assert [r.subcarpeta for r in spark.read.parquet(at("again")).collect()] == ["P2"]
    main(["references", "--dataset-path", at("src"), "--enunciados", at("e"), "--models", "gpt-4o,otro", "--versions", "2", "--tasks", at("gen")], spark)
    wanted = spark.read.parquet(at("gen"))
    assert sorted(r.archivo for r in wanted.collect()) == ["referencia_v1_gpt-4o.c", "referencia_v2_gpt-4o.c"]
    wanted.select("task", F.lit("```c\nint x;\n```").alias("answer"), F.lit(None).cast("string").alias("error")).distinct().write.parquet(at("code"))
    main(["references", "--dataset-path", at("src"), "--enunciados", at("e"), "--tasks", at("gen"), "--answers", at("code"), "--output", at("refs")], spark)
    made = spark.read.parquet(at("refs"))
    sinks.export_reference_files(made, at("out"))
    sinks.export_reference_files(made, at("out"))
    assert (tmp_path / "out/A/Z1/P1/referencia_v2_gpt-4o.c").read_text() == "int x;" and len(list((tmp_path / "out/A/Z1/P1").iterdir())) == 2
    main(["coverage", "--dataset-path", at("src"), "--output-path", at("out"), "--csv", at("c"), "--json", at("j"), "--verbose"], spark)
    assert {(r.subcarpeta, int(r.referencias_ia)) for r in spark.read.csv(at("c"), header=True).collect()} == {("P1", 2), ("P2", 0)}
    assert spark.read.json(at("j")).count() == 1 and "A/Z1" in capsys.readouterr().out


def test_tree(spark, tmp_path):
    """Empty problems, text files only, stray files, names that Spark's readers pass over, and no tree at all."""
    root = tmp_path / "src"
    put(root / "A/Z1/P1/a.c", b"int a\xff;")
    put(root / "A/Z1/P1/.hidden.cpp", "int h;")
    put(root / "A/Z1/P2/only.txt", "x")
    put(root / "A/Z1/stray.c", "x")
    put(root / "A/_Z2/P1/deep/er.c", "x")
    put(root / "B.c", "x")
    put(root / "C/Z1/P1/UP.C", "x")
    (root / "A/Z3/empty").mkdir(parents=True)
    (root / "D").mkdir()
    for ranges in (1, 5):
        found = tree.read_tree(spark, str(root), ranges=ranges)
        assert {tuple(r) for r in tree.problems_in(found).collect()} == {("A", "Z1", "P1", 2), ("A", "Z1", "P2", 0), ("A", "_Z2", "P1", 0), ("A", "Z3", "empty", 0), ("C", "Z1", "P1", 0)}
        assert {(r.archivo, r.ext, r.contenido, r.bytes) for r in tree.files_in(found).collect()} == {("a.c", "c", "int a;", 7), (".hidden.cpp", "cpp", "int h;", 6)}
    assert found.rdd.getNumPartitions() == 15
    assert tree.read_tree(spark, f"file://{root}", content=False).filter("contenido is not null").count() == 0
    assert tree.problems_in(tree.read_tree(spark, str(tmp_path / "none"))).count() == 0
    for k, name in enumerate(("c.c", "b.c", "a.c")):
        put(root / "C/Z1/P2" / name, "x")
        os.utime(root / "C/Z1/P2" / name, (1000 + k, 1000 + k))
    newest = tree.newest_first(tree.files_in(tree.read_tree(spark, str(root))).filter("subcarpeta = 'P2' and curso = 'C'"), 2)
    assert [(r.archivo, r.lugar) for r in newest.orderBy("lugar").collect()] == [("a.c", 1), ("b.c", 2)]
    put(root / "C/Z1/P2/referencia_v2_gpt-4o.c", "x")
    put(root / "C/Z1/P2/referencia_v2.c", "x")
    assert [(r.version, r.modelo) for r in tree.references_in(tree.read_tree(spark, str(root), tree.REFERENCE_FILE)).collect()] == [(2, "gpt-4o")]


def test_coverage_keeps_problems_without_code(spark, tmp_path, capsys):
    from cotejo.__main__ import main

    put(tmp_path / "src/A/Z1/P1/a.c", "int a;")
    put(tmp_path / "src/A/Z1/P2/notes.txt", "x")
    (tmp_path / "src/A/Z1/P3").mkdir()
    main(["coverage", "--dataset-path", str(tmp_path / "src"), "--output-path", str(tmp_path / "out"), "--csv", str(tmp_path / "c"), "--verbose"], spark)
    assert {(r.subcarpeta, int(r.archivos_originales)) for r in spark.read.csv(str(tmp_path / "c"), header=True).collect()} == {("P1", 1), ("P2", 0), ("P3", 0)}
    put(tmp_path / "e.csv", "curso,carpeta,subcarpeta,enunciado,lenguaje\nA,Z1,P1,u,C\nA,Z1,P3,v,C\nA,Z1,P9,w,C\n")
    capsys.readouterr()
    main(["references", "--dataset-path", str(tmp_path / "src"), "--enunciados", str(tmp_path / "e.csv"), "--models", "otro,gpt-4o", "--tasks", str(tmp_path / "gen")], spark)
    said = capsys.readouterr().err
    assert "model otro is unknown" in said and "1 statements passed over: no code" in said and "1 statements passed over: path missing" in said
    assert spark.read.parquet(str(tmp_path / "gen")).count() == 3


def test_appended_statements(spark, tmp_path):
    """A small batch, then a larger one, which Spark reads first; and a file that was there before."""
    schema = "curso string, carpeta string, subcarpeta string, enunciado string, lenguaje string"
    at = str(tmp_path / "store")
    put(tmp_path / "store/before.csv", "curso,carpeta,subcarpeta,enunciado,lenguaje\nA,Z,1,OLDEST,C\nA,Z,2,kept,C\n")
    assert sinks.append_statements(spark.createDataFrame([("A", "Z", "1", "OLD", "C")], schema), at) == 0
    large = [("A", "Z", "1", "NEW", "C")] + [("A", "Z", f"x{k}", "filler " * 50, "C") for k in range(2000)]
    assert sinks.append_statements(spark.createDataFrame(large, schema).repartition(3), at) == 1
    last = statements.last_wins(statements.read_statements(spark, at), KEY)
    assert {r.subcarpeta: r.enunciado for r in last.filter("subcarpeta in ('1', '2')").collect()} == {"1": "NEW", "2": "kept"}
    assert [r.subcarpeta for r in statements.limited(last, 2).collect()] == ["1", "2"]
    # several batches of one key within one batch's file, in order
    assert sinks.append_statements(spark.createDataFrame([("A", "Z", "1", f"v{k}", "C") for k in range(50)], schema).coalesce(1), at) == 2
    again = statements.last_wins(statements.read_statements(spark, at), KEY)
    assert again.filter("subcarpeta = '1'").first().enunciado == "v49"


def test_guilty_counts(spark):
    """Against listed pairs, also of students in several groups; groups are not joined with themselves."""
    rng = random.Random(2)
    rows = [("c", f"a{k % 2}", f"p{k % 3}", k % 4, f"s{rng.randrange(25)}") for k in range(150)] + [("c", "a0", "p9", 1, f"t{k}") for k in range(60)] + [("c", "a0", None, 1, "t1"), ("c", "a0", "p0", 1, None)]
    truth = spark.createDataFrame(rows, "curso string, carpeta string, subcarpeta string, group_id int, student string")
    want = {(a[1], a[4], b[4]) for a in rows for b in rows if a[:4] == b[:4] and None not in (*a, *b) and a[4] < b[4]}
    got = {(r.carpeta, r.student_a): r.n for r in traces.guilty_counts(truth).collect()}
    assert got == Counter(x[:2] for x in want) and sum(got.values()) > 60 * 59 / 2

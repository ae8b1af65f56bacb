"""The pipeline, stage by stage, and its registration."""

import brute
import fixtures as fx

import __spark_entry__
import corpus_pipeline


def test_registered():
    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and corpus_pipeline.ORACLE_SQL is None


def test_stages(spark):
    rows = fx.corpus()
    docs = fx.documents(spark, rows, extra=True)
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        out = stage(spark, docs, None)
        if name != "pack":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        if name == "near_dedup":
            groups = brute.near_groups(before, 5)
            assert sorted(r.doc_id for r in docs.collect()) == sorted({c for _, c in groups.values()})
        elif name == "secret_scan":
            texts = [r.text for r in docs.collect()]
            assert len(texts) == len(before) and not any(t and "hunter2" in t for t in texts)
    assert docs.count() > 20


def test_empty(spark):
    docs = fx.documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, None)
    assert docs.count() == 0


def test_stages_on_hard_rows(spark):
    """Null and repeated ids, repeated rows and null texts, given to each stage."""
    text = fx.words(3, 80)
    rows = [(None, text, "en", "a", 1), (None, text, "en", "a", 1), (None, None, None, None, None), (7, text, "en", "a", 1), (7, text, "en", "a", 2), (7, fx.words(4, 50), "de", "b", 1), (9, None, "en", "b", 1), (11, "token=abcdefgh1", "en", None, 1), (13, "", "en", "b", 1)]
    rows += [(100 + k, fx.words(k, 60), ["en", "de"][k % 2], "b", 1) for k in range(30)]
    docs = fx.documents(spark, rows, extra=True)
    out = {name: stage(spark, docs, None).collect() for name, stage in corpus_pipeline.STAGES}
    assert sorted((r.text for r in out["language_id"] if r.doc_id is None), key=str) in ([], [text, text])
    assert not [r for r in out["language_id"] if r.text in (None, "")]
    kept = sorted((str(r.doc_id), r.text or "") for r in out["near_dedup"] if r.doc_id is None or r.doc_id < 100)
    # of rows that repeat an id each text stays once
    assert kept == sorted([("None", text), ("None", text), ("None", ""), ("7", text), ("7", fx.words(4, 50)), ("9", ""), ("11", "token=abcdefgh1"), ("13", "")])
    assert len(out["secret_scan"]) == len(rows) and "***************" in {r.text for r in out["secret_scan"]}
    assert sum(len((r.text or "").split()) for r in out["mix_sources"]) > 0
    assert sorted({(str(r.doc_id), r.piece) for r in out["pack"]}) == sorted({(str(r[0]), 0) for r in rows}) and len(out["pack"]) == len(rows)


def test_tiny_texts(spark):
    """Thousands of texts of a word or two in a known language: sequences of many members."""
    rows = [(k, fx.words(k, 60), "en", "a", 1) for k in range(20)] + [(1000 + k, f"{fx.words(k, 2)}", "en", "a", 1) for k in range(3000)]
    docs = fx.documents(spark, rows)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, None)
        docs = spark.createDataFrame(out.collect(), out.schema)
    got = docs.collect()
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(got) > 2000 and all(sum(x[1] for x in b) <= 2048 for b in bins.values())
    assert len(bins) == -(-sum(r.length for r in got) // 2048)

"""Repeat removal and near duplicates against plain versions."""

import hashlib
import math
import os
import random
import tracemalloc

import brute
import fixtures as fx
import numpy as np
import pytest

from cotejo.llm import _repeats, embedding_dedup, minhash_dedup, substring_dedup, suffix_dedup
from cotejo.llm._components import components

HARD = [False, True]


@pytest.mark.parametrize("extra", HARD)
def test_repeated_words(spark, extra):
    got = substring_dedup.remove_repeats(fx.documents(spark, extra=extra)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute.repeated_words(fx.texts_by_id())
    assert sum(r.n_removed for r in got) > 500


@pytest.mark.parametrize("extra", HARD)
def test_repeated_bytes(spark, extra):
    got = suffix_dedup.remove_repeats(fx.documents(spark, extra=extra)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute.repeated_bytes(fx.texts_by_id())


def test_repeats_of_hard_rows(spark):
    text = fx.words(1, 80)
    rows = [(None, text, "en", "s", 1), (4, text, "en", "s", 1), (4, text, "en", "s", 1), (9, text, "en", "s", 1), (9, None, None, None, None)]
    for remove in (substring_dedup.remove_repeats, suffix_dedup.remove_repeats):
        got = sorted(((r.doc_id, r.n_removed) for r in remove(fx.documents(spark, rows)).collect()), key=str)
        whole = max(n for _, n in got)
        assert got == sorted([(None, 0), (4, 0), (4, 0), (9, whole), (9, 0)], key=str) and whole > 0
        assert remove(fx.documents(spark, [])).count() == 0


def chained(seed: int, n: int) -> list[tuple]:
    """Documents cut from a few others at random places, so that passages share parts of each other."""
    rng = random.Random(seed)
    bases = [fx.words(k, 400, 3000) for k in range(4)]
    rows = []
    for k in range(n):
        parts = []
        for _ in range(rng.randint(1, 4)):
            base = rng.choice(bases)
            at = rng.randrange(len(base) - 300)
            parts.append(base[at : at + rng.randint(20, 900)])
        rows.append((k, rng.choice([" ", "\n\t ", ""]).join(parts), "en", "s", 1))
    rows += [(n, "ab " * 400, "en", "s", 1), (n + 1, "x " + "ab " * 300, "en", "s", 1), (n + 2, "a" * 700, "en", "s", 1), (n + 3, "b" + "a" * 650, "en", "s", 1)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [2500, 1 << 20])
def test_repeats_across_blocks(spark, monkeypatch, size):
    """Passages that overlap in every way, with many small blocks and with few."""
    monkeypatch.setattr(_repeats, "BLOCK_BYTES", size)
    rows = chained(4, 120)
    docs, texts = fx.documents(spark, rows), fx.texts_by_id(rows)
    got = suffix_dedup.remove_repeats(docs).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute.repeated_bytes(texts)
    got = substring_dedup.remove_repeats(docs).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute.repeated_words(texts)


def test_kept_text(spark):
    rows = chained(5, 12)
    for r in substring_dedup.remove_repeats(fx.documents(spark, rows), keep_text=True).collect():
        assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 and len(r.kept.split()) == r.n_words - r.n_removed
    for r in suffix_dedup.remove_repeats(fx.documents(spark, rows), keep_bytes=True).collect():
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed


def test_what_the_automata_do_not_find_stays(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "occurrences", lambda *_: [])
    assert sum(r.n_removed for r in substring_dedup.remove_repeats(fx.documents(spark)).collect()) == 0


def test_what_the_suffix_order_does_not_tell_stays(spark, monkeypatch):
    """Two texts that share a passage, but no phrase with its first and last strings."""
    passage = fx.words(3, 30)
    rows = [(1, fx.words(1, 20) + passage + fx.words(2, 20), "en", "s", 1), (2, fx.words(4, 20) + passage + fx.words(5, 20), "en", "s", 1)]
    removed = lambda: {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(fx.documents(spark, rows)).collect()}
    assert removed()[2] >= len(passage)
    monkeypatch.setattr(suffix_dedup, "suffix_order", lambda data, at, depth: (np.arange(len(at)), np.ones(len(at), bool)))
    assert removed()[2] < len(passage)


def test_suffix_order():
    rng = random.Random(2)
    data = np.array([rng.choice([0, 1, 127, 128, 255]) for _ in range(4000)], np.uint8)
    at = np.arange(len(data) - 20)
    order, new = suffix_dedup.suffix_order(data, at, 20)
    held = [data[a : a + 20].tobytes() for a in at[order]]
    assert held == sorted(held) and new.tolist() == [True, *(a != b for a, b in zip(held, held[1:], strict=False))]


def test_more_passages_than_an_automaton_takes(monkeypatch):
    """One trigger with many phrases and several automata find what one finds."""
    shared = fx.words(8, 30, 5000).split(" ")
    phrases = [" ".join([*fx.words(k % 7, 30, 5000).split(" "), *shared, *fx.words(k % 5 + 50, 30, 5000).split(" ")]).encode() for k in range(60)]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in phrases])])
    shard = _repeats.Shard(np.frombuffer(b"".join(phrases), np.uint8), offsets, np.full(60, 40), np.arange(60), np.zeros(60, bool))
    found = []
    for most in (400_000, 100):
        monkeypatch.setattr(substring_dedup, "AUTOMATON_WORDS", most)
        found.append(sorted(zip(*map(list, substring_dedup.located(50, 8)(shard)), strict=True)))
    assert found[0] == found[1] and len({f[0] for f in found[0]}) > 50


SF = "/root/testdata/sf0.01/documents.parquet"


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables here")
def test_whole_table_against_plain(spark):
    """Every document of the test table, by each of the three operators."""
    docs = spark.read.parquet(SF).repartition(4)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = substring_dedup.remove_repeats(docs).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute.repeated_words(texts)
    got = suffix_dedup.remove_repeats(docs).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute.repeated_bytes(texts)
    got = minhash_dedup.near_duplicates(docs, width=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near_groups(texts)


def test_no_shared_folder(spark):
    from cotejo.llm import _session

    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: {"spark.master": "spark://host:7077"}.get(key, default))

    with pytest.raises(ValueError, match="checkpoint"):
        _session.shared_dir(Cluster)


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width):
    got = minhash_dedup.near_duplicates(fx.documents(spark, extra=True), width=width).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near_groups(fx.texts_by_id(), width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and sum(not r.kept for r in got) > 10


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """A large group of near copies, loosely chained, with buckets cut into small blocks."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    rng, base = random.Random(3), fx.words(3, 60).split(" ")
    rows = []
    for k in range(60):
        at = rng.randrange(len(base))
        base = [*base[:at], f"w{k}", *base[at + 1 :]]
        rows.append((k, " ".join(base), "en", "s", 1))
    rng.shuffle(rows)
    got = minhash_dedup.near_duplicates(fx.documents(spark, rows), width=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near_groups({r[0]: r[1] for r in rows})


def test_near_duplicates_of_hard_rows(spark):
    text = fx.words(1, 80)
    rows = [(None, text, "en", "s", 1), (4, text, "en", "s", 1), (4, text, "en", "s", 1), (9, text, "en", "s", 1), (9, fx.words(2, 50), "en", "s", 1), (11, fx.words(2, 50), "en", "s", 1)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(fx.documents(spark, rows)).collect()), key=str)
    assert got == sorted([(None, None, True), (4, 4, True), (4, 4, True), (9, 4, False), (9, 4, False), (11, 4, False)], key=str)
    kept = sorted((r.doc_id for r in minhash_dedup.keep_one(fx.documents(spark, rows)).collect()), key=str)
    assert kept == [4, None]
    assert minhash_dedup.near_duplicates(fx.documents(spark, [])).count() == 0
    assert minhash_dedup.keep_one(fx.documents(spark, [], extra=True)).columns == fx.documents(spark, [], extra=True).columns


def test_posterior_bounds():
    least = minhash_dedup.least_matches(80, 1e-5)
    assert least == sorted(least) and 0 < least[0] < 32 and least[-1] < 192
    # a pair at the bound is pruned less often than one time in a thousand
    n = minhash_dedup.BANDS * minhash_dedup.ROWS
    p = 0.8 + 0.2 / 256
    below = sum(math.comb(n, m) * p**m * (1 - p) ** (n - m) for m in range(least[-1]))
    assert below < 1e-3


@pytest.mark.parametrize("percent, miss", [(50, 1e-3), (80, 1e-5), (90, 0.2), (100, 1e-5)])
def test_posterior_bounds_take_little_of_the_driver(percent, miss):
    """The bounds are those of the plain posterior, in a few MB; all counts at once took 148 MB."""
    tracemalloc.start()
    least = minhash_dedup.least_matches(percent, miss)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8e6
    p = np.linspace(1 / 256, 1, 20_001)[1:-1]
    similar = (p - 1 / 256) / (1 - 1 / 256) >= percent / 100

    def posterior(m, n):
        log = m * np.log(p) + (n - m) * np.log1p(-p)
        weight = np.exp(log - log.max())
        return weight[similar].sum() / weight.sum()

    for k, m in enumerate(least):
        n = minhash_dedup.BATCH * (k + 1)
        if similar.any():
            assert posterior(m, n) >= miss and (m == 0 or posterior(m - 1, n) < miss)
        else:
            assert m == 0  # nothing is pruned


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    ids = sorted({x for link in links for x in link})
    want = brute.components(ids, links)
    assert {k: got.get(k, k) for k in ids} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(dim: int, n: int, seed: int = 1) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(2, n // 12), dim))
    rows = []
    for k in range(n):
        centre = centres[rng.integers(len(centres))]
        x = centre + rng.normal(size=dim) * np.linalg.norm(centre) / np.sqrt(dim) * rng.choice([0.0, 0.05, 0.1, 0.14, 0.2])
        rows.append((k, [float(v) for v in x.astype(np.float32)], int(rng.integers(2))))
    return rows


def links_of(rows) -> tuple[dict, dict]:
    ids, links, count = [r[0] for r in rows], [], {}
    for label in (0, 1):
        own = [r for r in rows if r[2] == label]
        x = np.array([r[1] for r in own])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = (x @ x.T >= 0.98) & ~np.eye(len(own), dtype=bool)
        for k, r in enumerate(own):
            count[r[0]] = int(near[k].sum())
        links += [(own[a][0], own[b][0]) for a, b in zip(*np.nonzero(near), strict=True)]
    return count, brute.components(ids, links)


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize(("dim", "n", "block"), [(64, 400, 2048), (64, 300, 4), (20, 200, 2048), (3, 60, 7), (100, 300, 2048)])
def test_embeddings(spark, dim, n, block):
    rows = vectors(dim, n)
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS).repartition(4), block=block).collect()
    count, component = links_of(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {k: (count[k], component[k]) for k in count}
    assert sum(count.values()) > 100


@pytest.mark.parametrize("bits", [8, 32])
def test_embeddings_with_other_tables(spark, monkeypatch, bits):
    """Short and long tables, and a third of the rows copies of one vector."""
    monkeypatch.setattr(embedding_dedup, "fitting_codes", lambda sample, threshold, rows: embedding_dedup.Codes(sample, threshold, bits))
    rows = vectors(64, 200, seed=3)
    rows += [(1000 + k, rows[5][1], rows[5][2]) for k in range(100)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS).repartition(4), block=64).collect()
    count, component = links_of(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {k: (count[k], component[k]) for k in count}
    assert count[1000] >= 100


def test_bits_of_tables():
    assert [embedding_dedup.table_bits(n) for n in (1, 1 << 16, (1 << 16) + 1, 1 << 20, 1 << 40)] == [16, 16, 17, 20, 32]


def test_embeddings_with_clashing_names(spark):
    rows = vectors(16, 60)
    docs = spark.createDataFrame(rows, VECTORS)
    clash = docs.selectExpr("*", "1 as weight", "'x' as n_links", "2 as component_id", "3 as named", "4 as bucket", "5 as n")
    plain = {tuple(r) for r in embedding_dedup.near_duplicates(docs).collect()}
    assert {tuple(r) for r in embedding_dedup.near_duplicates(clash).collect()} == plain


def test_embeddings_of_hard_rows(spark):
    one, zero = [1.0] + [0.0] * 7, [0.0] * 8
    rows = [(1, one, 1), (2, one, 1), (3, one, 2), (4, one, None), (5, zero, 1), (6, None, 1), (7, [], 1), (8, [None] * 8, 1), (9, [math.nan] * 8, 1), (10, [math.inf] + [0.0] * 7, 1), (None, one, 1), (2, one, 1), (11, [1.0], 1)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(got) == len(rows)
    linked = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert linked.pop(1) == (1, 1, True) and linked.pop(2) == (1, 1, False) and linked.pop(None) == (0, None, True)
    assert all(v == (0, k, True) for k, v in linked.items())
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_embeddings_of_extreme_size(spark):
    """Norms whose squares under- or overflow, alone and beside others: cosines are those of the directions."""
    tiny, huge = 1e-170, 1e170
    rows = [(0, [tiny] * 8, 1), (1, [1.0] * 8, 1), (2, [huge] * 8, 1), (3, [5e-324] * 8, 1), (4, [1e308] * 4 + [-1e308] * 4, 1), (5, [1.0] * 4 + [-1.0] * 4, 1), (6, [1e300] + [1e-300] * 7, 2), (7, [3.0] + [0.0] * 7, 2)]
    schema = "vec_id long, embedding array<double>, label int"
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, schema)).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 6)}
    alone = embedding_dedup.near_duplicates(spark.createDataFrame(rows[:1], schema)).collect()
    assert [(r.n_links, r.kept) for r in alone] == [(0, True)]


def test_shards_follow_the_texts():
    """Each shard stands for a bounded share of the texts, whatever the number of partitions."""
    for blocks in (0, 1, 100, 10_000, 10_000_000):
        shards = _repeats.shards_for(blocks, 8)
        assert shards >= 16 and blocks * _repeats.BLOCK_BYTES <= shards * _repeats.SHARD_BYTES and shards < 1 << 32


def test_one_header_in_all_documents(spark, monkeypatch):
    """A passage that every document begins with, followed by what differs, in many shards: equal to the plain versions."""
    monkeypatch.setattr(_repeats, "SHARD_BYTES", _repeats.BLOCK_BYTES // 8)
    header = fx.words(50, 60)
    rows = [(k, f"{header} {fx.words(400 + k, 30 + k % 50)}", "en", "s", 1) for k in range(120)]
    docs = fx.documents(spark, rows)
    texts = fx.texts_by_id(rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == brute.repeated_words(texts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == brute.repeated_bytes(texts)


@pytest.mark.parametrize("bits", [16, 24])
def test_long_vectors(spark, monkeypatch, bits):
    """Codes as long as the vectors, in many tables: links are those of all pairs."""
    monkeypatch.setattr(embedding_dedup, "fitting_codes", lambda sample, threshold, rows: embedding_dedup.Codes(sample, threshold, bits))
    rng = np.random.default_rng(bits)
    base = rng.normal(size=(60, 160))
    rows = [(k, (base[k % 60] + 0.05 * (k // 60) * rng.normal(size=160)).tolist(), k % 2) for k in range(240)]
    unit = np.array([v for _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    assert embedding_dedup.Codes(unit, 0.98, bits).tables == -(-160 // bits)
    near = (unit @ unit.T >= 0.98) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows])[None, :])
    schema = "vec_id long, embedding array<double>, label int"
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, schema)).collect()}
    assert got == {k: int(near[k].sum()) - 1 for k in range(len(rows))} and sum(got.values()) > 100


@pytest.mark.parametrize(("rows", "tables", "most"), [(1 << 10, 4, 100), (1 << 16, 4, 100), (1 << 22, 3, 300), (1 << 32, 2, 2000)])
def test_tables_grow_as_far_as_probes_pay(rows, tables, most):
    unit = np.random.default_rng(2).normal(size=(400, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    codes = embedding_dedup.fitting_codes(unit, 0.98, rows)
    at = codes.coordinates(unit[:100])
    assert codes.tables == tables and sum(len(codes.probes(at, t)[0]) for t in range(codes.tables)) / 100 < most

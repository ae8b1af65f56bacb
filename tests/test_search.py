"""Index, joins, regions, thresholds, groups and flow graphs against plain versions."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cotejo.functions import winnow
from cotejo.functions.text import KEYWORDS
from cotejo.operators import edit_join, flow, groups, lineage, regions, set_join, similarity, thresholds, trees, vector_index


def clustered(n, dim=16, centres=12, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    return [(k, int(k // 3 % 2), (middle[rng.integers(centres)] + 0.35 * rng.normal(size=dim)).tolist()) for k in range(n)]


def best(rows, queries, k):
    out = set()
    unit = {r[0]: np.array(r[2]) / np.linalg.norm(r[2]) for r in rows if r[2] and any(r[2])}
    label = {r[0]: r[1] for r in rows}
    for q in queries:
        scored = sorted((-round(float(unit[q] @ v), 6), i) for i, v in unit.items() if i != q and label[i] == label[q] and len(v) == len(unit[q]))
        out |= {(q, i, place) for place, (_, i) in enumerate(scored[:k], 1)}
    return out


def test_index(spark, tmp_path):
    """Exact search equals the whole scan, few probes find nine tenths, changes and additions are seen."""
    rows = clustered(1500)
    schema = "vec_id long, label int, embedding array<double>"
    wrong = [(i, label, [-x for x in v]) if i % 5 == 0 else (i, label, v) for i, label, v in rows[:900]]
    index = vector_index.build_index(spark.createDataFrame(wrong, schema), str(tmp_path / "i"), lists=30)
    index.add(spark.createDataFrame([r for r in rows if r[0] % 5 == 0 or r[0] >= 900], schema), 1)
    index = vector_index.open_index(spark, str(tmp_path / "i"))
    assert index.entries().count() == len(rows)
    asked = spark.createDataFrame([r for r in rows if r[0] % 20 == 0], schema)
    truth = best(rows, [r[0] for r in rows if r[0] % 20 == 0], 5)
    exact = index.search(asked, 5, probes=2, exact=True)
    assert {(r.vec_id, r.ref_id, r.lugar) for r in exact.collect()} == truth
    near = index.search(asked, 5, probes=6, exact=False)
    found = vector_index.recall(near, exact, asked.select("vec_id", F.col("label").cast("string").alias("label"))).collect()
    assert len(found) == 2 and all(r.recall >= 0.9 for r in found)
    few = index.probes_for(asked, 5)
    assert few <= 8
    chosen = vector_index.recall(index.search(asked, 5, few, exact=False), exact, asked.select("vec_id", F.col("label").cast("string").alias("label")))
    assert all(r.recall >= 0.9 for r in chosen.collect())


def test_index_reads_the_lists_it_needs(spark, tmp_path):
    rows = clustered(400)
    index = vector_index.build_index(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), str(tmp_path / "i"), lists=10)
    plan = index.search(spark.createDataFrame(rows[:1], "vec_id long, label int, embedding array<double>"), 3, probes=1, exact=False)
    assert plan.count() == 3
    entries = index.entries().filter(F.col("lista").isin([1]) & F.col("label").isin(["0"]))
    assert "In(lista" in entries._jdf.queryExecution().toString() or "EqualTo(lista" in entries._jdf.queryExecution().toString()


def test_index_of_hard_rows(spark, tmp_path):
    rows = [(1, 1, [1.0, 0.0]), (2, 1, [0.0, 0.0]), (3, None, [1.0, 0.0]), (4, 1, None), (5, 1, []), (6, 1, [1.0, 0.1]), (7, 1, [1.0, 0.1, 0.0]), (8, 2, [1.0, 0.0]), (9, 1, [2.0, 0.2])]
    schema = "vec_id long, label int, embedding array<double>"
    index = vector_index.build_index(spark.createDataFrame(rows, schema), str(tmp_path / "i"))
    got = {(r.vec_id, r.ref_id, r.similitud) for r in index.search(spark.createDataFrame(rows, schema), 5, exact=True).collect()}
    assert {(a, b) for a, b, _ in got} == {(1, 6), (1, 9), (6, 1), (6, 9), (9, 1), (9, 6)} and (6, 9, 1.0) in got
    empty = vector_index.build_index(spark.createDataFrame([], schema), str(tmp_path / "none"))
    assert empty.search(spark.createDataFrame(rows, schema)).count() == 0


def test_blocks_of_queries(spark, monkeypatch):
    """In several blocks the answers are those of one."""
    rows = spark.createDataFrame(clustered(120), "vec_id long, label int, embedding array<double>")
    whole = sorted(similarity.vector_search(rows, rows, 3).collect())
    means = sorted(similarity.mean_distances(rows, rows).collect())
    monkeypatch.setattr(similarity, "KERNEL_CELLS", 1200)
    assert len(similarity._query_blocks(rows)) > 2
    assert sorted(similarity.vector_search(rows, rows, 3).collect()) == whole and sorted(similarity.mean_distances(rows, rows).collect()) == means


def test_pairs_above(spark):
    rows = clustered(200) + [(900, 1, None), (901, None, [1.0] * 16), (902, 1, [0.0] * 16), (903, 1, [1.0] * 4)]
    schema = "vec_id long, label int, embedding array<double>"
    found = similarity.pairs_above(spark.createDataFrame(rows[::7], schema), spark.createDataFrame(rows, schema), 0.6)
    unit = {r[0]: np.array(r[2]) / np.linalg.norm(r[2]) for r in rows[:200]}
    want = {(a[0], b[0]) for a in rows[:200:7] for b in rows[:200] if a[0] != b[0] and a[1] == b[1] and round(float(unit[a[0]] @ unit[b[0]]), 6) >= 0.6}
    assert {(r.vec_id, r.ref_id) for r in found.collect()} == want


def test_references_in_blocks(spark, monkeypatch):
    """References that do not fit one kernel are looked through block by block, with the same result."""
    rng = random.Random(3)
    text = lambda n: " ".join("w" + "abcdefgh"[rng.randrange(8)] * rng.randint(1, 4) for _ in range(n))
    docs = spark.createDataFrame([(k, text(12)) for k in range(60)] + [(99, None), (98, "1 2 3")], "doc_id long, text string")
    items = spark.createDataFrame([(k, text(8)) for k in range(30)] + [(50, None)], "item_id long, text string")
    whole = sorted(map(str, similarity.best_reference(docs, items).select("doc_id", "referencia", "similitud").collect()))
    monkeypatch.setattr(similarity, "KERNEL_CELLS", 200)
    assert sorted(map(str, similarity.best_reference(docs, items).select("doc_id", "referencia", "similitud").collect())) == whole


def texts_of_sets(seed=2):
    rng = random.Random(seed)
    name = lambda k: "".join("abcdefghij"[int(d)] for d in str(k))
    out = [None, "", "12 34", "aa", "aa", "aa bb", "bb aa AA"]
    for base in range(25):
        words = [name(int(rng.paretovariate(0.6)) % 3000) for _ in range(rng.randint(3, 40))]
        for _ in range(4):
            changed = list(words)
            for _ in range(rng.randint(0, 4)):
                changed[rng.randrange(len(changed))] = name(rng.randrange(5000))
            out.append(" ".join(rng.sample(changed, len(changed))))
        out.append(" ".join(words))
    return list(enumerate(out))


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_set_join(spark, least):
    rows = texts_of_sets()
    texts, pairs = set_join.similar_sets(spark.createDataFrame(rows, "id long, text string").repartition(3), "id", least)
    sets = {i: frozenset(re.findall("[a-z]+", (t or "").lower())) for i, t in rows}
    alike = lambda x, y: len(x & y) * 1000 >= len(x | y) * round(least * 1000)
    first = {s: min(i for i in sets if sets[i] == s) for s in sets.values()}
    for r in texts.collect():
        own = sets[r.id]
        assert r.clase == (first[own] if own else r.id) and r.n_links == (sum(alike(own, sets[j]) for j in sets if j != r.id and sets[j]) if own else 0)
    want = {(a, b, round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6)) for a, b in itertools.combinations(sorted(set(first.values())), 2) if sets[a] and sets[b] and alike(sets[a], sets[b])}
    assert {tuple(r) for r in pairs.collect()} == want and texts.count() == len(rows)


def test_set_join_meets_few(spark):
    """Two words that all texts hold make no pair meet."""
    rows = [(k, f"the and x{chr(97 + k % 26)}{chr(97 + k // 26)}q " + " ".join("w" + chr(97 + (k * 7 + j) % 26) + chr(97 + (k + j * 3) % 26) for j in range(8))) for k in range(300)]
    numbers = set_join.numbered(spark.createDataFrame(rows, "clase long, text string").select("clase", F.array_distinct(similarity.tokens(F.col("text"))).alias("words")))
    assert set_join.candidates(numbers, 0.8).count() < 300 * 299 / 2 / 20
    with pytest.raises(ValueError):
        set_join.candidates(numbers, 0.0)


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_set_join_fetches_few_sets(spark, monkeypatch, least):
    """Texts of one stock of words meet by chance: their beginnings tell, and hardly a pair that is not similar has its sets fetched."""
    monkeypatch.setattr(set_join, "MORE", 8)
    rng, stock = random.Random(8), ["w" + a + b + c for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    rows = [(k, sorted(rng.sample(stock, rng.randint(30, 60)))) for k in range(150)]
    rows += [(1000 + k, sorted({*words[2:], "extra"})) for k, words in rows[:30]]
    numbers = set_join.numbered(spark.createDataFrame(rows, "clase long, words array<string>")).localCheckpoint()
    sets = {k: set(words) for k, words in rows}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}
    met = set_join.candidates(numbers, least)
    left = {tuple(r) for r in set_join.promising(met, numbers, least).collect()}
    assert want <= left and {(r.a, r.b) for r in set_join.similar_pairs(numbers, least).collect()} == want
    assert least < 0.8 or len(left) <= 1.5 * len(want)
    assert least != 0.8 or met.count() > 5 * len(want) > 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize(("k", "spare"), [(0, 2), (1, 2), (2, 0), (2, 2), (3, 2), (3, 1)])
def test_edit_join(spark, k, spare):
    rng = random.Random(k)
    strings = ["", "a", "b", "ab", "abc", "é", "éa", "common/beginning/é", None, None, "same", "same"]
    for base in range(12):
        word = "common/beginning/" * (base % 2) + "".join(rng.choice("abé") for _ in range(rng.randint(1, 14)))
        for _ in range(5):
            s = list(word)
            for _ in range(rng.randint(0, 4)):
                at = rng.randint(0, len(s))
                s[at : at + rng.randint(0, 1)] = rng.choice([[], ["a"], ["c"]])
            strings.append("".join(s))
    rows, pairs = edit_join.near_strings(spark.createDataFrame(list(enumerate(strings)), "id long, s string").repartition(3), "id", "s", k, spare)
    first = {s: strings.index(s) for s in strings if s is not None}
    want = {(first[a], first[b], d) if first[a] < first[b] else (first[b], first[a], d) for a, b in itertools.combinations(first, 2) if (d := distance(a, b)) <= k}
    assert {tuple(r) for r in pairs.collect()} == want
    for r in rows.collect():
        s = strings[r.id]
        assert r.n_links == (0 if s is None else sum(t is not None and distance(s, t) <= k for j, t in enumerate(strings) if j != r.id))
        assert r.clase == (r.id if s is None else first[s])


def test_edit_join_leaves_common_segments_out(spark):
    rows = [(k, f"https://www.example.org/common/{chr(97 + k % 26) * 5}{chr(97 + k // 26) * 5}{chr(97 + k % 7) * 5}") for k in range(400)]
    met = edit_join.candidates(spark.createDataFrame(rows, "id long, s string"), 2, spare=4).count()
    assert met < 400 * 399 / 2 / 4


def test_edit_join_of_a_crowd(spark, monkeypatch):
    """Addresses of one host share most segments: they meet in cells, not as rows of candidates, and no pair is lost."""
    monkeypatch.setattr(edit_join, "CROWD", 6)
    monkeypatch.setattr(edit_join, "BLOCK", 16)
    monkeypatch.setattr(edit_join, "AT_ONCE", 50)
    rng, joined, join = random.Random(9), [], edit_join._candidates
    monkeypatch.setattr(edit_join, "_candidates", lambda *x: joined.append(join(*x)) or joined[-1])
    host = lambda k: "http" + "s" * (k % 2) + "://" + ("www.", "", "")[k % 3] + "tionsh.example.net/"
    strings = sorted({host(rng.randrange(6)) + f"{rng.randrange(9000)}" + rng.choice(["", "/", "#é"]) for _ in range(120)} | {"http://other.org/a", "http://other.org/b", "x", "", "é"})
    rng.shuffle(strings)
    pairs = edit_join.near_strings(spark.createDataFrame(list(enumerate(strings)), "id long, s string").repartition(3), "id", "s", 3)[1]
    want = {(i, j, d) for (i, a), (j, b) in itertools.combinations(enumerate(strings), 2) if (d := distance(a, b)) <= 3}
    assert {tuple(r) for r in pairs.collect()} == want and pairs.count() == len(want) > 100
    few = sum(x.count() for x in joined)
    assert few < edit_join.candidates(spark.createDataFrame(list(enumerate(strings)), "id long, s string"), 3).count() / 4


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5])
def test_pairs_within(k):
    rng = random.Random(k)
    word = lambda n: "".join(rng.choice("abé𝄞\0"[: rng.choice([2, 5])]) for _ in range(n))
    for m, n in ((m, m + d) for m in (1, 2, 5, 11) for d in range(k + 1)):
        one, two = [word(m) for _ in range(12)], [word(n) for _ in range(15)]
        got = {(i, j, d) for i, j, d in zip(*map(np.ndarray.tolist, edit_join.pairs_within(one, two, k)), strict=True)}
        assert got == {(i, j, d) for i, x in enumerate(one) for j, y in enumerate(two) if (d := distance(x, y)) <= k}


def plain_fingerprints(text, k, window):
    text = "".join(c for c in (text or "").lower() if c not in " \t\n\x0b\f\r")
    h = [int(hashlib.md5(text[i : i + k].encode()).hexdigest()[:12], 16) for i in range(len(text) - k + 1)]
    return {min(h)} if 0 < len(h) < window else {min(h[i : i + window]) for i in range(len(h) - window + 1)}


@pytest.mark.parametrize(("k", "window"), [(12, 8), (5, 4), (1, 1), (20, 3), (2, 9)])
@pytest.mark.parametrize("size", [40, 1 << 20])
def test_fingerprints(spark, monkeypatch, k, window, size):
    """Whole arrays at a time, in parts of any size, give the fingerprints of a plain version, each once for a text."""
    monkeypatch.setattr(winnow, "BYTES", size)
    monkeypatch.setattr(winnow, "RUNS", 50)
    rng = random.Random(k)
    rows = [None, "", "a" * 12, "a" * 40] + ["".join(rng.choice("aB é\n𝄞€x\t\0"[: rng.choice([3, 10])]) for _ in range(rng.randrange(80))) for _ in range(40)]
    got = Counter((i, f) for of, chosen in winnow.fingerprints(pa.array(["zz", *((t or "").lower() for t in rows)]).slice(1), k, window) for i, f in zip(of.tolist(), chosen.tolist(), strict=True))
    assert got == Counter((i, f) for i, t in enumerate(rows) for f in plain_fingerprints(t, k, window))
    if size > 40:
        found = similarity.fingerprints(spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(rows)], "doc string, text string"), "doc", k, window)
        assert Counter((r.doc, r.fingerprint) for r in found.collect()) == Counter((f"d{i}", f) for i, f in got)


def test_shared_fingerprints_leave_texts_in_place(spark):
    docs, refs = (spark.createDataFrame([(j, f"{name} of one text, and of others {j}") for j in range(9)], f"{name} long, text string") for name in ("doc", "ref"))
    shared = similarity.shared_fingerprints(similarity.fingerprints(docs, "doc"), similarity.fingerprints(refs, "ref"), "doc", "ref")
    prints = [{(j): plain_fingerprints(f"{name} of one text, and of others {j}", 5, 4) for j in range(9)} for name in ("doc", "ref")]
    assert {(r.doc, r.ref): r.n for r in shared.collect()} == {(i, j): len(x & y) for i, x in prints[0].items() for j, y in prints[1].items() if x & y}
    assert "SortMergeJoin" not in shared._jdf.queryExecution().executedPlan().toString()


def plain_regions(a, b, least):
    a, b = ("".join((t or "").lower().split()) for t in (a, b))
    out = set()
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i] == b[j] and not (i and j and a[i - 1] == b[j - 1]):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                if n >= least:
                    out.add((i, j, n))
    return out


@pytest.mark.parametrize(("k", "window", "hot"), [(5, 4, 2000), (5, 4, 3), (6, 1, 5), (3, 3, 2000)])
def test_regions(spark, k, window, hot):
    rng = random.Random(k)
    word = lambda n, letters="abcde": "".join(rng.choice(letters) for _ in range(n))
    shared = [word(30), word(12), "ab" * 20]
    refs = [(k, " ".join([word(20), shared[k % 3], word(10), shared[(k + 1) % 3]])) for k in range(5)] + [(9, None), (10, ""), (11, "aaaa" * 8)]
    texts = [(k, f"{word(25)}\n{shared[k % 3].upper()} {word(9)}{shared[(k * 2) % 3]}{word(5)}") for k in range(8)] + [(20, None), (21, "ab"), (22, "a" * 40), (23, refs[0][1])]
    found = regions.matched_regions(spark.createDataFrame(texts, "doc long, text string"), spark.createDataFrame(refs, "ref long, text string"), "doc", "ref", k, window, hot)
    want = {(d, r, *x) for d, t in texts for r, u in refs for x in plain_regions(t, u, k + window - 1)}
    assert {tuple(x) for x in found.collect()} == want
    covered = {(r.doc, r.ref): (r.cubierto, r.mayor, r.regiones) for r in regions.coverage_of(found, "doc", "ref").collect()}
    plain = defaultdict(list)
    for d, r, i, _, n in want:
        plain[d, r].append((i, n))
    assert covered == {p: (len({c for i, n in xs for c in range(i, i + n)}), max(n for _, n in xs), len(xs)) for p, xs in plain.items()}
    with pytest.raises(ValueError):
        regions.matched_regions(found, found, "doc", "ref", 3, 4)


@pytest.mark.parametrize(("seed", "buckets"), [(1, 1000), (2, 7), (3, 1)])
def test_thresholds(spark, seed, buckets):
    rng = random.Random(seed)
    rows = [(round(rng.betavariate(3, 2) if (y := rng.random() < 0.4) else rng.betavariate(2, 3), 2), int(y)) for _ in range(400)] + [(None, 1), (float("nan"), 0), (0.5, None), (1.0, 1), (0.0, 0)]
    df = spark.createDataFrame(rows, "s double, y int")
    clean = [(s, y) for s, y in rows if s is not None and s == s and y is not None]
    pos, neg = [s for s, y in clean if y], [s for s, y in clean if not y]
    counts = thresholds.score_counts(df, "s", "y", buckets=buckets)
    points = thresholds.curve(counts)
    for r in points.collect():
        assert r.tp == sum(s >= r.umbral for s in pos) and r.fp == sum(s >= r.umbral for s in neg)
    area = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert thresholds.area(points).first().area == round(area, 6)
    for below in (0.1, 0.003, 0.5, 2.0):
        got = thresholds.lowest_threshold(counts, below).collect()
        fits = [u for u in {s for s, _ in clean} if sum(s >= u for s in neg) / len(neg) < below]
        assert [r.umbral for r in got] == ([min(fits)] if fits else [])
        assert all(r.fp == sum(s >= r.umbral for s in neg) and r.tp == sum(s >= r.umbral for s in pos) for r in got)


def test_thresholds_without_cases(spark):
    for rows in ([], [(0.3, 1)], [(0.3, 0)]):
        df = spark.createDataFrame(rows, "s double, y int")
        counts = thresholds.score_counts(df, "s", "y")
        assert thresholds.area(thresholds.curve(counts)).first().area is None
        assert thresholds.lowest_threshold(counts).count() == 0


def test_components(spark):
    rng = random.Random(4)
    chain = [(k, k + 1) for k in range(100, 160)]
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + chain + [(200, k) for k in range(201, 230)] + [(None, 3), (7, 7)]
    got = {r.id: r.grupo for r in groups.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {x: x for p in pairs for x in p if None not in p}
    for _ in root:
        for a, b in pairs:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert groups.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_agreement(spark):
    rng = random.Random(6)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice("abc")) for _ in range(60)] + [(9, None)]
    got = groups.agreement(spark.createDataFrame(rows, "f int, t string"), "f", "t").first()
    both = found = true = agree = total = 0
    for (f, t), (g, u) in itertools.combinations(rows, 2):
        x, y = f is not None and f == g, t is not None and t == u
        both, found, true, agree, total = both + (x and y), found + x, true + y, agree + (x == y), total + 1
    assert (got.ambos, got.hallados, got.verdaderos, got.todos) == (both, found, true, total)
    assert (got.precision, got.recall, got.rand) == (round(both / found, 6), round(both / true, 6), round(agree / total, 6))
    chance = found * true / total
    assert got.rand_ajustado == round((both - chance) / ((found + true) / 2 - chance), 6)
    none = groups.agreement(spark.createDataFrame([], "f int, t string"), "f", "t").first()
    assert none.todos == 0 and none.precision is None and none.rand is None


def plain_flow(code, rounds):
    """Histograms of refined labels from the arcs that ``flow.edges`` tells, by nested tuples instead of digests."""
    nodes, arcs = code
    label = {p: d for p, d in nodes.items()}
    out = [Counter(label.values())]
    for _ in range(rounds):
        label = {p: (label[p], tuple(sorted([("<", label[s]) for s, t in arcs if t == p] + [(">", label[t]) for s, t in arcs if s == p], key=repr))) for p in nodes}
        out.append(Counter(label.values()))
    return out


def test_flow_refinement(spark):
    codes = {
        0: "int f(int n) { int t = n; t += n; return t; }",
        1: "int g(int cuenta) { int suma = cuenta; suma += cuenta; return suma; }",
        2: "int f(int n) { int t = n; n = t; return n + t; }",
        3: "int h(int a) { int b = a; int c = b; int d = c; return d; }",
        4: "",
        5: None,
    }
    df = spark.createDataFrame(list(codes.items()), "id long, contenido string")
    found = flow.refined_labels(df, "id", rounds=3)
    nodes, arcs = defaultdict(dict), defaultdict(list)
    for r in flow.occurrences(df, "id").collect():
        nodes[r.id][r.pos] = "d" if r.defines else "u"
    for r in flow.edges(df, "id").collect():
        arcs[r.id].append((r.src, r.dst))
    got = defaultdict(lambda: defaultdict(Counter))
    for r in found.collect():
        got[r.id][r.ronda][r.etiqueta] += r.n
    plain = {k: plain_flow((nodes[k], arcs[k]), 3) for k in nodes}
    for k, hist in plain.items():
        assert [sorted(got[k][i].values()) for i in range(4)] == [sorted(h.values()) for h in hist]
    for a, b in itertools.combinations(nodes, 2):
        for i in range(4):
            assert sum((got[a][i] & got[b][i]).values()) == sum((plain[a][i] & plain[b][i]).values())
    classes = flow.flow_classes(found, "id")
    assert {r.id: r.clase for r in classes.collect()} == {0: 0, 1: 0, 2: 2, 3: 3}
    dot = lambda x, y: sum(x[i][t] * y[i][t] for i in range(4) for t in x[i])
    want = {(a, b): round(dot(plain[a], plain[b]) / math.sqrt(dot(plain[a], plain[a]) * dot(plain[b], plain[b])), 6) for a, b in ((0, 2), (0, 3), (2, 3))}
    assert {(r.a, r.b): r.similitud for r in flow.kernel_similarities(found, classes, "id").collect()} == want


def plain_tree(code):
    """(label, children) of a program, by walking its tokens with a stack."""
    tokens = re.findall(flow._TOKEN, re.sub(r"//[^\n]*|/\*.*?\*/", "", code, flags=re.S))
    root = ("#", [])
    stack, inside, fresh, last = [root], 0, True, None
    for t in tokens:
        inside += (t == "(") - (t == ")")
        if fresh and t not in ("}", ";") or fresh and t == ";" and inside > 0:
            name = "ID" if re.fullmatch(r"[A-Za-z_]\w*", t) and t not in KEYWORDS else t
            last = (name, [])
            stack[-1][1].append(last)
        fresh = t in "{}" or t == ";" and inside <= 0
        if t == "{":
            stack.append(last)
        elif t == "}" and len(stack) > 1:
            last = stack.pop()
    return root


def plain_grams(tree, parent="*", q=3):
    label, children = tree
    padded = ["*"] * (q - 1) + [c[0] for c in children] + ["*"] * (q - 1) if children else ["*"] * q
    out = Counter(f"{parent} {label} | {' '.join(padded[i : i + q])}" for i in range(len(padded) - q + 1))
    for c in children:
        out += plain_grams(c, label, q)
    return out


def test_trees(spark):
    codes = [
        "int f(int n) { for (int i = 0; i < n; i++) { if (i) { g(i); } else { return i; } } return n; }",
        "int otra(int m) { for (int j = 0; j < m; j++) { if (j) { h(j); } else { return j; } } return m; }",
        "int f() { { int a = 1; } { a = 2; ; } while (1) { } }\nint main() { return f(); }",
        "// nothing\n",
        "int a; int b = 2;",
        "int f() { return 1; } } int g;",
    ]
    df = spark.createDataFrame([*enumerate(codes), (99, None)], "id long, contenido string")
    profiles = trees.profile(df, "id")
    got = defaultdict(Counter)
    for r in profiles.collect():
        got[r.id][r.gram] += r.n
    want = {k: plain_grams(plain_tree(c)) for k, c in enumerate(codes)}
    assert dict(got) == want and got[3] == {"* # | * * *": 1}
    classes = trees.tree_classes(profiles, "id")
    assert {r.id: r.clase for r in classes.collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 5}
    apart = {(r.a, r.b): (r.distancia, r.cota) for r in trees.tree_distances(profiles, classes, "id").collect()}
    for a, b in itertools.combinations((0, 2, 3, 4, 5), 2):
        shared, both = sum((want[a] & want[b]).values()), sum(want[a].values()) + sum(want[b].values())
        assert apart.get((a, b)) == ((round(1 - 2 * shared / both, 6), both - 2 * shared) if shared else None)


def test_lineage(spark):
    """Against a replay that holds which file has which name."""
    rng, rows, want = random.Random(5), [], {}
    for trace in ("a", "b"):
        holder: dict = {}
        for seq in range(120):
            kind = rng.choice(["created", "rename", "rename", "modified", "deleted"])
            name, old = (rng.choice(["x.c", "y.c", "z.c", "w.c"]) for _ in range(2))
            rows.append((trace, seq, kind, name, old if kind == "rename" and rng.random() < 0.95 else None))
            old = rows[-1][4]
            if kind == "created":
                holder[name] = f"creado:{seq}"
            elif kind == "rename":
                holder[name] = holder.get(old, f"inicial:{old}") if old else f"inicial:{name}"
            want[trace, seq] = holder.get(name, f"inicial:{name}")
    rows += [("a", 500, "created_folder", None, None), ("c", 0, "rename", "n.c", "n.c"), ("c", 1, "rename", "m.c", "n.c")]
    want |= {("c", 0): "inicial:n.c", ("c", 1): "inicial:n.c"}
    events = spark.createDataFrame(rows, "file string, seq long, text string, filename string, old_filename string").repartition(4)
    assert {(r.file, r.seq): r.identidad for r in lineage.file_lineage(events).collect()} == want
    assert lineage.file_lineage(events.limit(0)).count() == 0

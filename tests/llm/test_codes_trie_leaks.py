"""Vector codes, the prefix trie and decontamination, each against a plain version and on hard rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import fixtures as fx
import numpy as np
import pytest
from pyspark.sql import functions as F

from cotejo.llm import decontamination, prefix_trie, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int"
TURNS = "conv_id long, turn int, role string, text string"


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error), and the digest of the codebooks; rows are (vec_id, vector, label)."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[int(np.floor(4096 * np.float64(np.float32(x)))) for x in v] for _, v, _ in rows]
    width = len(whole[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda: [[min(range(len(books[p])), key=lambda k: far(v[p], books[p][k])) for p in range(parts)] for v in cut]
    for _ in range(rounds):
        at = near()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [v[p] for v, a in zip(cut, at, strict=True) if a[p] == k]
                if own:
                    books[p][k] = [sum(xs) // len(own) for xs in zip(*own, strict=True)]
    at = near()
    errors = [sum(far(v[p], books[p][a[p]]) for p in range(parts)) for v, a in zip(cut, at, strict=True)]
    by_label = defaultdict(int)
    for (_, _, label), e in zip(rows, errors, strict=True):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(r[0]), bytes(a).hex(), e, by_label[r[2]]) for r, a, e in zip(rows, at, errors, strict=True)), digest


def vectors(seed, n, dim=16, grid=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x = np.round(x * grid) / grid if grid else x
    return [(k, [float(np.float32(v)) for v in x[k]], [None, 1, 2][k % 3]) for k in range(n)]


@pytest.mark.parametrize(("n", "grid"), [(300, None), (300, 1), (300, 2), (9, None), (1, None)])
def test_codes_against_plain(spark, n, grid):
    """A coarse grid has many ties: equal parts, and parts halfway between entries."""
    rows = vectors(n, n, grid=grid)
    got = vector_codes.compress(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    want, digest = plain_codes(rows)
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in got) == want
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_bounds_save_scans(spark):
    """Parts around 16 centres: after the first rounds nearly none is compared with all entries again."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(16, 16)) * 3
    rows = [(k, (centres[k % 16] + rng.normal(size=16) * 0.05).tolist(), 0) for k in range(2000)]
    books, state = vector_codes.learn(spark.createDataFrame(rows, VECTORS))
    assert books.entries.shape == (8, 16, 2)
    assert state.agg(F.sum("scans")).first()[0] < 0.1 * 8 * len(rows)
    codes = vector_codes.encode(state, books).collect()
    shown = {r.vec_id: books.decode(r.code) for r in codes}
    assert all(np.abs(np.array(shown[k]) - np.array(np.float32(v))).max() < 0.5 for k, v, _ in rows)


def test_bounds_never_decide_ties():
    """An entry that moves to the same distance as a lower one gives way to it."""
    parts = np.array([[[0]], [[2]]], np.int64)
    first = vector_codes.Codebooks(np.array([[[-3], [1]]], np.int64))
    bounds, scans = vector_codes.assign(parts, first, None, first.half_way)
    assert bounds.entry.ravel().tolist() == [1, 1] and scans == 2
    moved = first.after({(0, 0): (1, [-1])})
    bounds, _ = vector_codes.assign(parts, moved, bounds, moved.half_way)
    assert bounds.entry.ravel().tolist() == [0, 1]


def test_codes_of_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = vectors(5, 40)
    bad = [(100, None, 1), (101, [], 1), (102, [nan] * 16, 1), (103, [inf] * 16, 1), (104, [None] * 16, 1), (105, [0.5] * 8, 1), (106, [0.5] * 15, 1)]
    more = [(None, [0.25] * 16, None), (3, [0.5] * 16, None), (3, [0.5] * 16, None), (200, [0.0] * 16, 1)]
    docs = spark.createDataFrame(good + bad + more, VECTORS)
    got = vector_codes.compress(docs.withColumns({c: F.lit("clash") for c in ("parts", "entry", "error", "code", "of", "n")})).collect()
    want, digest = plain_codes(good + more)
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in got) == want and got[0].codebooks_sha256 == digest
    assert vector_codes.compress(docs.filter("vec_id between 100 and 104")).count() == 0 and vector_codes.compress(docs.limit(0)).count() == 0
    huge = [(k, [1e30 * (-1) ** k, 3.0] * 8, 1) for k in range(20)]
    assert {r.error for r in vector_codes.compress(spark.createDataFrame(huge, VECTORS)).collect()} == {0}
    with pytest.raises(ValueError):
        vector_codes.compress(docs, entries=200)


def test_squares_beyond_doubles():
    a, b = np.array([[2**28, -(2**28)]], np.int64), np.array([[-(2**28), 2**28 - 1], [0, 1]], np.int64)
    assert vector_codes.squared(a, b).tolist() == [[sum((int(x) - int(y)) ** 2 for x, y in zip(a[0], e, strict=True)) for e in b]]


def plain_trie(rows):
    """Rows (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), sorted."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            key = (role or "", text or "")
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(key[0])}:{key[0]}{key[1]}".encode()).digest(), key))
    own = {c: [t[-1] for t in sorted(ts)] for c, ts in own.items()}
    members = defaultdict(list)
    rebuilt = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(own.get(c - c % 5, [])[:h] + ts[h:])
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []
    for node, cs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        ends = ",".join(str(c) for c in sorted(cs) if rebuilt[c] == node)
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        out.append((min(cs), len(node), str(min(members[node[:-1]]) if node else None), len(cs), len(children[node]), sum(not children[x] for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def trie_rows(found):
    return sorted((r.conv_id, r.depth, str(r.parent_conv_id), r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found.collect())


@pytest.mark.parametrize("seed", range(3))
def test_trie_against_plain(spark, seed):
    """Few different turns, so that paths meet, end inside others and repeat."""
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(400), 150):
        for turn in range(rng.randint(1, 12)):
            rows.append((c, turn, rng.choice(["user", None]), rng.choice(["a", "bé", "", None, "ccc"])))
    rng.shuffle(rows)
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(5))
    assert trie_rows(found) == plain_trie(rows)
    placed = found.select("place", "end", "depth", "n_convs").collect()
    assert sorted(r.place for r in placed) == list(range(1, len(placed) + 1)) and all(r.place <= r.end for r in placed)


def test_trie_of_hard_rows(spark):
    """Nulls, repeated turns and rows, one conversation of a third of all turns, one conversation many times, a turnless one."""
    rows = [(None, 0, "user", "x"), (7, None, None, None), (7, None, "user", "x"), (7, 0, "user", "x"), (7, 0, "user", "x"), (7, 0, "user", "x")]
    rows += [(20, t, "user", f"{t % 3}") for t in range(300)]
    rows += [(c, t, "user", "same") for c in range(1000, 1200, 5) for t in range(4)]
    rows += [(c, 0, "user", "gone") for c in range(2001, 2030)]  # no base: those whose first turn is replaced have none
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("clash") for c in ("node", "rank", "size", "base", "h", "n")}))
    assert trie_rows(found) == plain_trie(rows)
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    one = prefix_trie.prefix_trie(spark.createDataFrame([(2, 0, "user", "x" * 100_000)], TURNS))
    assert trie_rows(one) == plain_trie([(2, 0, "user", "x" * 100_000)])


def test_ends_in_pieces(spark, monkeypatch):
    """Ids of one node that fill many pieces and several tasks."""
    monkeypatch.setattr(prefix_trie, "TOGETHER", 7)
    ids = [*range(1, 3000, 3), 10**12]
    rows = spark.createDataFrame([(bytes(16), c) for c in ids] + [(b"\x01" * 16, 5)], "node binary, conv_id long").repartition(6)
    got = {bytes(r["at"]): r.ends_sha256 for r in prefix_trie.ends_of(rows).collect()}
    assert got == {bytes(16): hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), b"\x01" * 16: hashlib.sha256(b"5").hexdigest()}


def plain_hits(docs, benchmark, width=10):
    """Sorted rows (doc_id, n_words, hit positions, item ids)."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for item, text in benchmark:
        w = words(text)
        for k in range(max(len(w) - width, 0) + 1 if w else 0):
            windows[tuple(w[k : k + width])].add(item)
    out = []
    for doc, text in docs:
        w, hit, items = words(text), set(), set()
        for n in {len(g) for g in windows}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    items |= windows[g]
        out.append((str(doc), len(w), sorted(hit), sorted(str(x) for x in items if x is not None)))
    return sorted(out)


def leak_cases():
    rng = random.Random(8)
    items = [(k, fx.words(k, rng.randint(10, 40), 60)) for k in range(30)] + [(40, "two words"), (41, ""), (42, None), (43, " .,;"), (None, fx.words(77, 20)), (3, fx.words(78, 12)), (44, "École №5 DÉJÀ vu")]
    docs = [(k, fx.words(k + 500, 120)) for k in range(20)]
    for k, (_, text) in enumerate(items):
        inside = (text or "").upper().replace(" ", " -\n")
        docs.append((100 + k, f"{fx.words(k + 900, 30)} {inside} {fx.words(k + 950, 30)}"))
        cut = (text or "").split()
        docs.append((200 + k, " ".join(cut[1:10]) + " x " + " ".join(cut[-11:])))
    return docs + [(None, None), (None, "two words"), (5, ""), (5, "Two-Words two words"), (6, fx.words(1, 30_000, 60)), (7, "decole no5 vu")], items


@pytest.mark.parametrize("shard_bytes", [decontamination.SHARD_BYTES, 700])
def test_contamination_against_plain(spark, shard_bytes):
    """In one shard, and in several that are scanned in turn."""
    docs, items = leak_cases()
    left = spark.createDataFrame([(k, t) for k, t in docs], "doc_id long, text string").repartition(4)
    right = spark.createDataFrame(items, "item_id long, text string")
    if shard_bytes == 700:
        assert len(list(decontamination.shards_of(right, shard_bytes=shard_bytes))) > 2
    found = decontamination.find_contamination(left, right, shard_bytes=shard_bytes)
    got = sorted((str(r.doc_id), r.n_words, [k for x in r.spans for k in range(x.start, x.end)], list(r["items"])) for r in found.collect())
    assert got == plain_hits(docs, items)
    for r in decontamination.digest(found).collect():
        assert r.contaminated == (r.n_hit > 0) and len(r.items_sha256) == 64
    told = {(str(r.doc_id), r.n_words): r for r in decontamination.digest(found).collect()}
    assert all(told[d, n].n_hit == len(hit) and told[d, n].n_items == len(ids) and told[d, n].items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest() for d, n, hit, ids in plain_hits(docs, items))


def test_pieces_keep_every_window(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE", 5)
    docs, items = leak_cases()
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_contamination(left, right).collect()
    assert sorted((str(r.doc_id), r.n_words, [k for x in r.spans for k in range(x.start, x.end)], list(r["items"])) for r in found) == plain_hits(docs, items)


def test_equal_hashes_are_compared(monkeypatch):
    """With one hash for all windows only those whose words agree are hits."""
    import pyarrow as pa

    monkeypatch.setattr(decontamination, "span_hashes", lambda prefix, start, end: np.zeros(len(start), np.uint64))
    known = decontamination.WindowSet.of(pa.table({"item": ["a", "b"], "words": ["one two three", "four five six"]}), 2)
    data = np.frombuffer(b"zero four five six one", np.uint8)
    first, which = known.hits(decontamination.words_of(data, np.array([0, len(data)])))
    assert sorted(first.tolist()) == [1, 2] and {known.items[k] for w in which for k in known.held[known.held_offsets[w] : known.held_offsets[w + 1]]} == {"b"}


@pytest.mark.parametrize("shard_bytes", [decontamination.SHARD_BYTES, 700])
def test_clean(spark, shard_bytes):
    leak = fx.words(3, 25)
    rows = [(1, f"Before, {leak.replace(' ', ' - ')}. After!", "en"), (2, "nothing here", None), (3, None, "en"), (4, leak, "de"), (4, leak, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("row", "spans", "items", "n_words")})
    benchmark = spark.createDataFrame([(9, leak), *((20 + k, fx.words(300 + k, 30)) for k in range(9))], "item_id long, text string")
    cut = decontamination.clean(docs, benchmark, shard_bytes=shard_bytes)
    assert cut.columns == docs.columns and sorted((r.doc_id, r.text) for r in cut.collect() if r.text) == [(1, "Before, . After!"), (2, "nothing here")] and cut.count() == 5
    assert sorted(r.doc_id for r in decontamination.clean(docs, benchmark, "documents", shard_bytes=shard_bytes).collect()) == [2, 3]
    assert sorted(r.doc_id for r in decontamination.clean(docs, benchmark, "documents", least_share=0.95, shard_bytes=shard_bytes).collect()) == [1, 2, 3]
    empty = benchmark.limit(0)
    assert decontamination.clean(docs, empty).count() == 5 and decontamination.clean(docs.limit(0), benchmark).count() == 0
    assert {r.contaminated for r in decontamination.digest(decontamination.find_contamination(docs, empty)).collect()} == {False}
    with pytest.raises(ValueError):
        decontamination.clean(docs, benchmark, "words")

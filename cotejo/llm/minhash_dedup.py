"""MinHash near-dedup with sequential Bayesian verification of banded candidates.

A text's set is its distinct word shingles. Texts with equal sets are one *class*, known
by its first document; only these go on. A signature holds one byte of each of
``BANDS * ROWS`` min-hashes, and the bytes of a band are the key of a bucket. Two sets of
similarity 0.8 miss all buckets with a probability of 5e-6.

Candidates are compared signature batch by signature batch. With a uniform prior, ``m`` of
``n`` equal bytes give a posterior of the similarity; a pair is pruned as soon as the
posterior probability of a link falls below ``MISS``. Survivors are verified exactly, on
the full sets of both whole texts.

This takes three rounds, each of which ends with the components of the links it has verified:

1. Each member of a bucket of several blocks is compared with the bucket's first document.
2. Buckets whose members are in different components are dealt into cells of bounded size. The members of
   a bucket's largest component meet the others, but not each other. Each cell sends a spanning forest of its
   candidates, the most similar ones first, for verification.
3. Members that still have candidates in other components are dealt into cells with their texts, and all their
   pairs are verified there. Only links that join components leave a cell.

So pairs never leave a cell but as forests, which are smaller than the cell, and no link between
components is lost. A pair counts in the first band it shares only.

Defined results: a null or empty text has an empty set and links with nothing, nor
does a row with a null id; rows that repeat an id are one document with the links of all
of them; an empty table gives an empty result; only doc_id and text are read, other
columns are kept as they are where rows are filtered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.llm._components import components
from cotejo.llm._session import partitions, written
from cotejo.llm._text import U64, mix, sliding_hashes, text_chunks, word_bounds, word_hashes

#: Words of a shingle and least similarity in percent, unless a caller says otherwise.
WIDTH, PERCENT = 5, 80
BANDS, ROWS = 40, 6
#: Posterior probability of a link below which a candidate is pruned, and bytes in a batch.
MISS, BATCH = 1e-5, 40
#: Most members of a bucket in a block, and most shingles of them if a text alone has no more.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
PAIRS_AT_ONCE = 20_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, in order, and n+1 offsets."""
    data = LOWER[data]
    starts, ends, words = word_bounds(data, offsets)
    codes = word_hashes(data, starts, ends)
    count = np.diff(words)
    text = np.repeat(np.arange(len(count)), count)
    hashes, owner = [], []
    for k in range(1, width + 1):
        # texts with fewer words than a shingle are one shingle as a whole
        runs = sliding_hashes(codes, k)
        if not len(runs):
            break
        inside = (text[: len(runs)] == text[k - 1 :]) & ((count[text[: len(runs)]] == k) if k < width else True)
        hashes.append(mix(runs[inside] + U64(k)) if k < width else runs[inside])
        owner.append(text[: len(runs)][inside])
    if not hashes:
        return np.empty(0, U64), np.zeros(len(offsets), np.int64)
    hashes, owner = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(len(offsets)))


def signatures(hashes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """uint8[text, BANDS * ROWS] of non-empty sets: one byte of each least hash."""
    rng = np.random.default_rng(11)
    odd = rng.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    low, high = hashes.astype(np.uint32), (hashes >> U64(32)).astype(np.uint32)
    out = np.empty((len(edges) - 1, BANDS * ROWS), np.uint8)
    for k in range(BANDS * ROWS):
        least = np.minimum.reduceat(low * odd[k] ^ high, edges[:-1])
        out[:, k] = (least * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)
    return out


def least_matches(percent: int, miss: float) -> list[int]:
    """For each number of batches, the fewest equal bytes that leave a link possible enough.

    The driver looks at one number of equal bytes after the other; all of them at once would take 150 MB of it.
    """
    p = np.linspace(1 / 256, 1, 20_001)[1:-1]
    similar = (p - 1 / 256) / (1 - 1 / 256) >= percent / 100
    equal, other = np.log(p), np.log1p(-p)

    def enough(m: int, n: int) -> bool:
        log = m * equal + (n - m) * other
        weight = np.exp(log - log.max())
        return weight[similar].sum() / weight.sum() >= miss

    return [next((m for m in range(n + 1) if enough(m, n)), 0) for n in range(BATCH, BANDS * ROWS + 1, BATCH)]


def set_rows(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_key, n_shingles and, of sets that are not empty, their 128-bit key and signature."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_chunks(batch, "text"):
                hashes, edges = shingle_sets(data, offsets, width)
                size = np.diff(edges)
                full = np.flatnonzero(size)
                none = size == 0
                k1, k2 = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
                signed = np.empty((0, BANDS * ROWS), np.uint8)
                if len(full):
                    own = np.append(edges[full], len(hashes))
                    k1[full] = np.add.reduceat(mix(hashes ^ U64(0x5851F42D4C957F2D)), own[:-1]).view(np.int64)
                    k2[full] = np.add.reduceat(mix(hashes), own[:-1]).view(np.int64)
                    signed = signatures(hashes, own)
                held = iter(signed)
                sigs = pa.array([None if e else next(held).tobytes() for e in none], pa.binary())
                columns = [part.column("doc_id"), part.column("text_key"), pa.array(size), pa.array(k1, mask=none), pa.array(k2, mask=none), sigs]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n_shingles", "k1", "k2", "sig"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(made, f"doc_id {id_type}, text_key long, n_shingles long, k1 long, k2 long, sig binary")


def _keys() -> F.Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda t: F.struct(t.cast("byte").alias("band"), F.xxhash64(t, F.substring(F.col("sig"), t * ROWS + 1, F.lit(ROWS))).alias("key")),
    )


def _blocks(n: F.Column, shingles: F.Column) -> F.Column:
    return F.greatest(F.ceil(n / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def live_rows(firsts: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes that share a bucket with another one, and the buckets of two or more.

    Classes, each once: doc_id, text_key, n_shingles, sig, text and their keys. Buckets: key, the
    first document in it and the number of blocks.
    """
    entries = firsts.select("doc_id", "text_key", "n_shingles", F.explode(_keys()).alias("at")).select("doc_id", "text_key", "n_shingles", "at.band", "at.key")
    first = F.min(F.struct("doc_id", "text_key")).alias("hub")
    buckets = entries.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"), first).filter("n > 1")
    buckets = written(buckets.select("key", _blocks(F.col("n"), F.col("shingles")).alias("blocks"), "hub"), "minhash-buckets")
    keys = entries.join(buckets.select("key", "blocks"), "key").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("band", "key", "blocks")).alias("keys"))
    live = firsts.join(keys, ["doc_id", "text_key"])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    texts = texts.join(live.select("doc_id", "text_key"), ["doc_id", "text_key"], "left_semi").groupBy("doc_id", "text_key").agg(F.first("text").alias("text"))
    return written(live.join(texts, ["doc_id", "text_key"]), "minhash-live"), buckets


def verify(pairs: DataFrame, live: DataFrame, width: int, percent: int) -> DataFrame:
    """a and b of the pairs of classes that are linked, from their full sets."""

    def side(name: str) -> DataFrame:
        return live.select(F.col("doc_id").alias(name), F.col("text_key").alias(f"{name}_key"), F.col("text").alias(f"{name}_text"))

    # classes stand once in ``live``, so Spark can split a hub's pairs
    both = pairs.join(side("b"), ["b", "b_key"]).join(side("a"), ["a", "a_key"])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            done = 0
            for part, data, offsets in text_chunks(batch, "a_text"):
                a, a_edges = shingle_sets(data, offsets, width)
                at = 0
                for other, b_data, b_offsets in text_chunks(part, "b_text"):
                    b, b_edges = shingle_sets(b_data, b_offsets, width)
                    for k in range(len(other)):
                        x, y = a[a_edges[at + k] : a_edges[at + k + 1]], b[b_edges[k] : b_edges[k + 1]]
                        shared = len(np.intersect1d(x, y, assume_unique=True))
                        linked[done + at + k] = 100 * shared >= percent * (len(x) + len(y) - shared)
                    at += len(other)
                done += len(part)
            at = np.flatnonzero(linked)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(at)), batch.column("b").take(pa.array(at))], ["a", "b"])

    return both.mapInArrow(judged, "a long, b long")


def _surviving(sigs: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray, least: list[int], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that no batch prunes, and how many bytes they share."""
    fit = 100 * np.minimum(sizes[i], sizes[j]) >= percent * np.maximum(sizes[i], sizes[j])
    i, j = i[fit], j[fit]
    same = np.zeros(len(i), np.int64)
    for k, enough in enumerate(least):
        batch = slice(k * BATCH, (k + 1) * BATCH)
        same += (sigs[i, batch] == sigs[j, batch]).sum(axis=1)
        left = same >= enough
        i, j, same = i[left], j[left], same[left]
    return i, j, same


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), BANDS * ROWS)


_PAIR = "a long, a_key long, b long, b_key long"


def _pairs(doc: np.ndarray, key: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[pa.Array]:
    swap = (doc[j] < doc[i]) | ((doc[j] == doc[i]) & (key[j] < key[i]))
    a, b = np.where(swap, j, i), np.where(swap, i, j)
    return [pa.array(doc[a]), pa.array(key[a]), pa.array(doc[b]), pa.array(key[b])]


def star_pairs(live: DataFrame, buckets: DataFrame, percent: int) -> DataFrame:
    """Surviving pairs of a class and the first one of a bucket it is in, for buckets of several blocks."""
    least = least_matches(percent, MISS)
    member = live.select("doc_id", "text_key", F.explode("keys").alias("at")).filter("at.blocks > 1").select("doc_id", "text_key", F.col("at.key").alias("key"))
    hubs = buckets.filter("blocks > 1").select("key", F.col("hub.doc_id").alias("hub"), F.col("hub.text_key").alias("hub_key"))
    # a class meets the same hub in many buckets: once is enough
    met = member.join(hubs, "key").filter("doc_id <> hub or text_key <> hub_key").select("doc_id", "text_key", "hub", "hub_key").distinct()
    own = live.select("doc_id", "text_key", "n_shingles", "sig")
    theirs = own.toDF("hub", "hub_key", "hub_shingles", "hub_sig")
    both = met.join(own, ["doc_id", "text_key"]).join(theirs, ["hub", "hub_key"])

    def pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sigs = np.concatenate([_matrix(batch.column("sig")), _matrix(batch.column("hub_sig"))])
            sizes, doc, key = (np.concatenate([batch.column(x).to_numpy(), batch.column(y).to_numpy()]) for x, y in (("n_shingles", "hub_shingles"), ("doc_id", "hub"), ("text_key", "hub_key")))
            i, j, _ = _surviving(sigs, sizes, np.arange(n), np.arange(n, 2 * n), least, percent)
            yield pa.RecordBatch.from_arrays(_pairs(doc, key, i, j), ["a", "a_key", "b", "b_key"])

    return both.mapInArrow(pruned, _PAIR).distinct()


class Union:
    """Numbered components that pairs join."""

    def __init__(self, component: np.ndarray):
        self.of = np.unique(component, return_inverse=True)[1].ravel()
        self.root = np.arange(int(self.of.max(initial=-1)) + 1)

    def _find(self, x: int) -> int:
        while (up := int(self.root[x])) != x:
            self.root[x] = self.root[up]
            x = up
        return x

    def join(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs join components that none before them has joined."""
        joined = []
        for k, (a, b) in enumerate(zip(self.of[i].tolist(), self.of[j].tolist(), strict=True)):
            a, b = self._find(a), self._find(b)
            if a != b:
                self.root[a] = b
                joined.append(k)
        return np.array(joined, np.int64)

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        while (up := self.root[self.root] != self.root).any():
            self.root[up] = self.root[self.root][up]
        return self.root[self.of[i]] != self.root[self.of[j]]


_CELL = ["key", "lo", "hi"]
_MEMBER = "key long, lo int, hi int, side int, band byte, component long, doc_id long, text_key long"


def cells(live: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of every bucket that has several components, in cells of two blocks at most.

    A bucket's largest component has blocks of its own, which meet those of the other members only.
    """
    at = live.select("doc_id", "text_key", "n_shingles", F.explode("keys").alias("at")).select("doc_id", "text_key", "n_shingles", "at.band", "at.key")
    named = at.join(roots.select(F.col("id").alias("doc_id"), "component_id"), "doc_id", "left").withColumn("component", F.coalesce("component_id", "doc_id"))
    counts = named.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    mixed = counts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.max(F.struct("n", "s", "component")).alias("main")).filter("parts > 1")
    blocks = _blocks(F.col("n") - F.col("main.n"), F.col("s") - F.col("main.s")).alias("blocks")
    mixed = written(mixed.select("key", F.col("main.component").alias("main"), blocks, _blocks(F.col("main.n"), F.col("main.s")).alias("main_blocks")), "minhash-mixed")
    member = named.join(mixed, "key").withColumn("in_main", F.col("component") == F.col("main"))
    place = lambda n: F.pmod(F.xxhash64("doc_id", "text_key"), n).cast("int")
    member = member.withColumn("side", F.when(F.col("in_main"), F.col("blocks") + place(F.col("main_blocks"))).otherwise(place(F.col("blocks"))))
    met = F.sequence(F.lit(0), F.col("blocks") + F.when(F.col("in_main"), 0).otherwise(F.col("main_blocks")) - 1)
    cell = member.select("key", "side", "band", "component", "doc_id", "text_key", F.explode(met).alias("with"))
    return cell.select("key", F.least("side", "with").alias("lo"), F.greatest("side", "with").alias("hi"), "side", "band", "component", "doc_id", "text_key")


def _dealt(cell_rows: DataFrame, live: DataFrame, columns: list[str]) -> DataFrame:
    full = cell_rows.join(live.select("doc_id", "text_key", *columns), ["doc_id", "text_key"])
    return full.repartition(partitions(live.sparkSession), *_CELL).sortWithinPartitions(*_CELL, "component", "doc_id", "text_key")


def _candidates(part: pa.RecordBatch, least: list[int], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Surviving pairs of different components in whole cells, the most similar ones first, and each member's cell."""
    sizes, component, band, side = (part.column(c).to_numpy() for c in ("n_shingles", "component", "band", "side"))
    new = np.ones(part.num_rows, bool)
    new[1:] = np.any([part.column(c).to_numpy()[1:] != part.column(c).to_numpy()[:-1] for c in _CELL], axis=0)
    cell = np.cumsum(new) - 1
    cell_end = np.searchsorted(cell, cell, "right")
    new[1:] |= component[1:] != component[:-1]
    run = np.cumsum(new) - 1
    run_end = np.searchsorted(run, run, "right")
    found = [(np.empty(0, np.int64),) * 3]
    if (run_end != cell_end).any():
        sigs = _matrix(part.column("sig"))
        across = part.column("lo").to_numpy() != part.column("hi").to_numpy()
        for i, j in between(run_end, cell_end, PAIRS_AT_ONCE):
            fit = ~across[i] | (side[i] != side[j])
            i, j, same = _surviving(sigs, sizes, i[fit], j[fit], least, percent)
            shared = (sigs[i] == sigs[j]).reshape(len(i), BANDS, ROWS).all(axis=2)
            first = shared.argmax(axis=1) == band[i]
            found.append((i[first], j[first], same[first]))
    i, j, same = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(-same, kind="stable")
    return i[order], j[order], same[order], cell


def _in_cell(component: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """A number for each component of each cell."""
    order = np.lexsort((component, cell))
    new = np.ones(len(order), bool)
    new[1:] = (component[order][1:] != component[order][:-1]) | (cell[order][1:] != cell[order][:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def forest_pairs(live: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Of each cell's candidates a spanning forest of the components that they join."""
    from cotejo.llm.embedding_dedup import whole_cells

    least = least_matches(percent, MISS)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_cells(batches, _CELL):
            i, j, _, cell = _candidates(part, least, percent)
            doc, key, component = (part.column(c).to_numpy() for c in ("doc_id", "text_key", "component"))
            taken = Union(_in_cell(component, cell)).join(i, j)
            yield pa.RecordBatch.from_arrays(_pairs(doc, key, i[taken], j[taken]), ["a", "a_key", "b", "b_key"])

    return _dealt(cells(live, roots), live, ["n_shingles", "sig"]).mapInArrow(compared, _PAIR).distinct()


def open_members(live: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """The members of cells that still have candidates in another component."""
    from cotejo.llm.embedding_dedup import whole_cells

    least = least_matches(percent, MISS)
    names = [x.split(" ")[0] for x in _MEMBER.split(", ")]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_cells(batches, _CELL):
            i, j, _, _ = _candidates(part, least, percent)
            yield part.select(names).take(pa.array(np.unique(np.concatenate([i, j]))))

    return _dealt(cells(live, roots), live, ["n_shingles", "sig"]).mapInArrow(compared, _MEMBER)


def links_in_cells(members: DataFrame, live: DataFrame, width: int, percent: int) -> DataFrame:
    """a and b: links that join components, from verifying all candidates of each cell on full sets."""
    from cotejo.llm.embedding_dedup import whole_cells

    least = least_matches(percent, MISS)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_cells(batches, _CELL, rows=BLOCK):
            i, j, _, cell = _candidates(part, least, percent)
            if not len(i):
                continue
            # the sets of all members as sorted (member, shingle) pairs, the shingles numbered
            sets = [shingle_sets(data, offsets, width) for _, data, offsets in text_chunks(part, "text")]
            size = np.concatenate([np.diff(edges) for _, edges in sets])
            _, shingle = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True)
            edges = np.concatenate([[0], np.cumsum(size)])
            held = np.sort(np.repeat(np.arange(len(size)), size) << 32 | shingle.ravel())
            doc, union, links = part.column("doc_id").to_numpy(), Union(_in_cell(part.column("component").to_numpy(), cell)), []
            small, large = np.where(size[i] <= size[j], i, j), np.where(size[i] <= size[j], j, i)
            upto, lo = np.cumsum(size[small]), 0
            while lo < len(i):
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + 500_000)))
                x, y = small[lo:hi], large[lo:hi]
                lo = hi
                apart = union.apart(x, y)
                x, y = x[apart], y[apart]
                n = size[x]
                which = np.repeat(np.arange(len(x)), n)
                ask = (held[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + edges[x][which]] & 0xFFFFFFFF) | y[which] << 32
                at = np.minimum(np.searchsorted(held, ask), len(held) - 1)
                shared = np.bincount(which[held[at] == ask], minlength=len(x))
                linked = 100 * shared >= percent * (n + size[y] - shared)
                x, y = x[linked], y[linked]
                new = union.join(x, y)
                links.append((x[new], y[new]))
            x, y = (np.concatenate(c) for c in zip(*links, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(doc[x]), pa.array(doc[y])], ["a", "b"])

    return _dealt(members, live, ["n_shingles", "sig", "text"]).mapInArrow(compared, "a long, b long")


def between(first: np.ndarray, end: np.ndarray, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j) with first[i] <= j < end[i], at most about ``at_once`` at a time."""
    more = end - first
    sums, lo = np.cumsum(more), 0
    while lo < len(more):
        before = sums[lo - 1] if lo else 0
        hi = min(len(more), max(lo + 1, int(np.searchsorted(sums, before + at_once, "right"))))
        n = more[lo:hi]
        i = np.repeat(np.arange(lo, hi), n)
        yield i, first[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        lo = hi


def links_in_open_cells(live: DataFrame, roots: DataFrame, width: int, percent: int) -> DataFrame:
    """a and b: the links between components that their members' cells still hold."""
    members = written(open_members(live, roots, percent), "minhash-open")
    return written(links_in_cells(members, live, width, percent), "minhash-links")


def near_duplicates(docs: DataFrame, *, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and kept of every row of ``docs``."""
    sets = written(set_rows(docs, width), "minhash-sets")
    usable = sets.filter(F.col("doc_id").isNotNull() & F.col("sig").isNotNull()).withColumn("doc_id", F.col("doc_id").cast("long"))
    firsts = usable.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "text_key", "n_shingles", "sig")).alias("v"))
    classes = written(firsts.select("k1", "k2", "v.*"), "minhash-classes")
    live, buckets = live_rows(classes.drop("k1", "k2").dropDuplicates(["doc_id", "text_key"]), docs)

    def verified(pairs: DataFrame) -> DataFrame:
        # each step is a table of its own: small plans, and lost executors cost one step
        return written(verify(written(pairs, "minhash-pairs"), live, width, percent), "minhash-links")

    # rows that repeat an id are one document: their classes hang together
    repeated = usable.groupBy("doc_id").agg(F.min("k1").alias("k"), F.max("k1").alias("l")).filter("k <> l").select(F.col("doc_id").alias("a"))
    same_id = usable.select(F.col("doc_id").alias("a"), "k1", "k2").join(repeated, "a", "left_semi").join(classes.select("k1", "k2", F.col("doc_id").alias("b")), ["k1", "k2"])
    links = written(same_id.filter("a <> b").select("a", "b").distinct(), "minhash-same-ids")
    if not buckets.filter("blocks > 1").isEmpty():
        links = links.unionByName(verified(star_pairs(live, buckets, percent)))
    roots = components(links)
    for found in (lambda: verified(forest_pairs(live, roots, percent)), lambda: links_in_open_cells(live, roots, width, percent)):
        links = found()
        if not links.isEmpty():
            roots = components(roots.select(F.col("id").alias("a"), F.col("component_id").alias("b")).unionByName(links))
    members = sets.join(classes.select("k1", "k2", F.col("doc_id").alias("first")), ["k1", "k2"], "left")
    named = members.join(roots.select(F.col("id").alias("first"), "component_id"), "first", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "first", F.col("doc_id").cast("long")))
    return named.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, *, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates, the one of the least id; columns stay as they are.

    Rows with a null id stay; of rows that repeat id and text one stays, the one whose columns
    hash lowest (maps, which have no hash, aside).
    """
    judged = written(near_duplicates(docs, width=width, percent=percent), "minhash-judged")
    kept = judged.filter("kept and doc_id is not null").groupBy("doc_id", "text_key").agg(F.count("*").alias("n"))
    kept = kept.select(F.col("doc_id").alias("_kept_id"), F.col("text_key").alias("_kept_key"), F.col("n").alias("_kept_rows"))
    keyed = docs.withColumn("_row_key", F.xxhash64("text"))
    joined = keyed.join(kept, (F.col("doc_id") == F.col("_kept_id")) & (F.col("_row_key") == F.col("_kept_key")))
    hashed = F.xxhash64(*(f.name for f in docs.schema if "map<" not in f.dataType.simpleString()))
    repeated = joined.filter("_kept_rows > 1").groupBy("_kept_id", "_kept_key").agg(F.min_by(F.struct(*docs.columns), hashed).alias("row"))
    return joined.filter("_kept_rows = 1").select(docs.columns).unionByName(repeated.select("row.*")).unionByName(docs.filter(F.col("doc_id").isNull()))

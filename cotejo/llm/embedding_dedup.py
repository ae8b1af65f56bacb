"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

Equal vectors of a label are one vector with a weight, known by its least id, so copies are
neither probed for nor compared. A rotation is learned on a bounded sample so that the signs of the rotated
coordinates make balanced codes that stray little from them (ITQ). The code is cut into
tables of ``TABLE_BITS`` bits, or more where the largest label has more than 2**16 different vectors and the wider tables'
probes cost less than the chance meetings that they save, as counted on the sample. Vectors meet in a bucket of a table: every vector is at
*home* under its own bits, and *probes* the keys that a linked vector could have.

Which keys these are follows from the coordinates, so no link is lost. Linked unit
vectors are at most d apart, ``d**2 = 2 - 2 * threshold``, in the rotated space too;
in one of m tables the squared distance is at most ``d**2 / m``. There, two vectors
that differ in the signs S have ``sum((|x_i| + |y_i|)**2 for i in S) <= d**2 / m``.
With x the one that is shorter over S, this needs
``|x_S|**2 + min|x_i| * |x_S| <= d**2 / (2 * m)``; so each vector probes the S that fulfil
this for itself, and of two linked ones at least one finds the other. A vector with
all coordinates near zero probes all keys of a table, and nothing is capped.

Buckets that could not hold a pair are dropped before vectors are fetched. Large
buckets are cut into blocks, and pairs of blocks (cells) are compared apart. Candidates
are reranked with the original vectors in double precision. A linked pair may meet in
several buckets; the first of them, which both vectors' coordinates tell, counts it.
Cells return counts and spanning forests, never pairs. Rotated coordinates are integers
and their sums exact, so they come out alike in every task.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null id or label, link with nothing; vectors of different
lengths do not link; of rows that repeat an id the one with the least (label, vector)
is compared, and all get its result; an empty table gives an empty result; only vec_id,
label and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.llm._components import components
from cotejo.llm._session import partitions, written
from cotejo.llm._text import mix

THRESHOLD = 0.98
SAMPLE = 4096
#: Most bits of a code, which has as many as vectors are long, and least and most bits of a table.
CODE_BITS, TABLE_BITS, MOST_TABLE_BITS = 1024, 16, 32
#: Vectors of the sample whose probes are counted to choose table bits, and comparisons that cost as much as one row of a probe.
MEASURED, ROW_COST = 32, 20
#: Rows of a bucket that are compared with each other in one cell.
BLOCK = 2048
#: Units of a rotated coordinate, of a normalised component and of the rotation.
UNIT, COMPONENT, TURN = 1 << 15, float(1 << 20), float(1 << 16)
PAIRS_AT_ONCE = 20_000
STATES_AT_ONCE = 2_000_000


def learn_rotation(vectors: np.ndarray, bits: int, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Mean and (dim, bits) projection with orthonormal columns, by iterative quantisation."""
    rng = np.random.default_rng(7)
    dim = vectors.shape[1]
    if len(vectors) < 2 * dim:
        return np.zeros(dim), np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :bits]
    mean = vectors.mean(axis=0)
    centred = vectors - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    main = axes[:, ::-1][:, :bits]
    low = centred @ main
    turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.where(low @ turn >= 0, 1.0, -1.0).T @ low)
        turn = (left @ right).T
    return mean, main @ turn


class Codes:
    """Integer coordinates of vectors of one length, cut into tables."""

    def __init__(self, sample: np.ndarray, threshold: float, table_bits: int = TABLE_BITS, learned: tuple[np.ndarray, np.ndarray] | None = None):
        dim = sample.shape[1]
        # the longer the code, the more tables there are, and the less far off each has to be probed
        self.bits = min(CODE_BITS, dim)
        self.tables = -(-self.bits // table_bits)
        self.edges = np.linspace(0, self.bits, self.tables + 1).astype(int)
        mean, turn = learned or learn_rotation(sample, self.bits)
        self.turn = np.rint(turn * TURN)
        self.mean = np.rint(mean * COMPONENT)
        # with room for the rounding of the rotation
        self.most = (1 - threshold) / self.tables * UNIT**2 * 1.002

    def coordinates(self, vectors: np.ndarray) -> np.ndarray:
        """Whole numbers; every operation is exact or by element, so the batch does not matter."""
        norm = np.zeros(len(vectors))
        for k in range(vectors.shape[1]):
            norm += vectors[:, k] ** 2
        whole = np.rint(vectors / np.sqrt(norm)[:, None] * COMPONENT) - self.mean
        return np.floor((whole @ self.turn) * (UNIT / COMPONENT / TURN)).astype(np.int64)

    def keys(self, coordinates: np.ndarray) -> np.ndarray:
        """int64[vector, table]: the signs of each table as a number."""
        out = np.empty((len(coordinates), self.tables), np.int64)
        for t in range(self.tables):
            lo, hi = self.edges[t], self.edges[t + 1]
            out[:, t] = (coordinates[:, lo:hi] >= 0) @ (1 << np.arange(hi - lo))
        return out

    def sizes(self, coordinates: np.ndarray, t: int) -> np.ndarray:
        """What each coordinate of table t is at least in size, rounding aside."""
        return np.maximum(np.abs(coordinates[:, self.edges[t] : self.edges[t + 1]]) - 2, 0)

    def reaches(self, squares: np.ndarray, least: np.ndarray) -> np.ndarray:
        return squares + least * np.sqrt(squares.astype(np.float64)) <= self.most

    def probes(self, coordinates: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Row and flipped signs of every probe into table t."""
        sizes = self.sizes(coordinates, t)
        order = np.argsort(sizes, axis=1, kind="stable")
        sizes = np.take_along_axis(sizes, order, axis=1)
        squares = sizes**2
        width = sizes.shape[1]
        rows, flips = [], []
        row = np.arange(len(sizes))
        row, last = np.repeat(row, width), np.tile(np.arange(width), len(sizes))
        mask, square, least = 1 << order[row, last], squares[row, last], sizes[row, last]
        while len(row):
            open_ = square <= self.most
            row, last, mask, square, least = row[open_], last[open_], mask[open_], square[open_], least[open_]
            hit = self.reaches(square, least)
            rows.append(row[hit]), flips.append(mask[hit])
            more = width - 1 - last
            at = np.repeat(np.arange(len(row)), more)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(more) - more, more)
            row, last = row[at], last[at] + 1 + nth
            mask, square, least = mask[at] | 1 << order[row, last], square[at] + squares[row, last], least[at]
        return np.concatenate(rows), np.concatenate(flips)

    def chunks(self, coordinates: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of rows whose probes are few enough to enumerate at once."""
        states = np.zeros(len(coordinates))
        for t in range(self.tables):
            states = np.maximum(states, 2.0 ** (self.sizes(coordinates, t) ** 2 <= self.most).sum(axis=1))
        sums, lo = np.cumsum(states), 0
        while lo < len(sums):
            before = sums[lo - 1] if lo else 0.0
            hi = max(lo + 1, int(np.searchsorted(sums, before + STATES_AT_ONCE)))
            yield lo, min(hi, len(sums))
            lo = hi

    def first_meeting(self, x: np.ndarray, y: np.ndarray, table: np.ndarray, y_home: np.ndarray, both_home: np.ndarray, y_least: np.ndarray) -> np.ndarray:
        """Whether linked pairs, met in ``table``, meet there first and nowhere else in it before.

        x and y are coordinates; y is at home in the bucket if ``y_home``; ``y_least`` tells if y has the smaller id.
        """
        first = np.ones(len(x), bool)
        kx, ky = self.keys(x), self.keys(y)
        for t in range(self.tables):
            lo, hi = self.edges[t], self.edges[t + 1]
            differ = (kx[:, t] ^ ky[:, t])[:, None] >> np.arange(hi - lo) & 1 == 1
            same = ~differ.any(axis=1)
            reach = []
            for v in (x, y):
                sizes = self.sizes(v, t)
                reach.append(self.reaches(np.where(differ, sizes**2, 0).sum(axis=1), np.where(differ, sizes, UNIT * 4).min(axis=1)))
            met = same | reach[0] | reach[1]
            first &= ~(met & (t < table))
            # where each is at home in a bucket that the other probes, the smaller id's home counts
            larger_reaches = np.where(y_least, reach[0], reach[1])
            larger_home = y_home != y_least
            first &= ~((t == table) & ~both_home & larger_home & larger_reaches)
        return first


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors, each times the power of two that brings its largest component to 0.5 to 1: their squares neither over- nor underflow, and no cosine changes."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), -1)
    _, exponent = np.frexp(np.abs(flat).max(axis=1, initial=0))
    return np.ldexp(flat, -exponent[:, None])


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    lengths = pa.compute.list_value_length(batch.column("embedding")).to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths):
        yield int(dim), batch.filter(pa.array(lengths == dim))


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member that each of n members is linked with through pairs (a, b)."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        np.minimum.at(new, root, new.copy())
        new = new[new]
        if (new == root).all():
            return root
        root = new


def vectors_of(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and embedding of the vectors that can link, one for each id."""
    valid = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("named"), F.col("embedding").cast("array<double>").alias("embedding")).filter(
        F.col("vec_id").isNotNull() & F.col("named").isNotNull() & valid & F.exists("embedding", lambda x: x != 0)
    )
    one = usable.groupBy("vec_id").agg(F.min(F.struct("named", "embedding")).alias("v"))
    return one.select("vec_id", F.xxhash64("v.named").alias("label"), F.col("v.embedding").alias("embedding"))


def weighed(vectors: DataFrame) -> DataFrame:
    """label, embedding, vec_id and weight: each different vector of a label, by its least id, and how often it is there."""
    return vectors.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"))


def table_bits(rows: int) -> int:
    """Most bits of a table for a label of so many vectors: a key for each."""
    return min(MOST_TABLE_BITS, max(TABLE_BITS, (rows - 1).bit_length()))


def fitting_codes(sample: np.ndarray, threshold: float, rows: int) -> Codes:
    """Codes whose tables cost a label of so many vectors least.

    Wider tables bring fewer vectors together by chance, but have to be probed at more places: a probe is a row that is sent, and a
    vector met there a comparison. Probes are counted on some vectors of the sample, from narrow tables to wide ones, as long as it pays.
    """
    best = Codes(sample, threshold, TABLE_BITS, learned := learn_rotation(sample, min(CODE_BITS, sample.shape[1])))
    if table_bits(rows) == TABLE_BITS or not len(sample):
        return best

    def cost(codes: Codes) -> float:
        at = codes.coordinates(sample[:MEASURED])
        probes = sum(len(codes.probes(at, t)[0]) for t in range(codes.tables)) / len(at)
        return (codes.tables + probes) * (ROW_COST + rows / 2 ** (codes.bits / codes.tables))

    least = cost(best)
    for tables in range(best.tables - 1, -(-best.bits // table_bits(rows)) - 1, -1):
        codes = Codes(sample, threshold, -(-best.bits // tables), learned)
        if (now := cost(codes)) >= least:
            break
        best, least = codes, now
    return best


def learn_codes(vectors: DataFrame, threshold: float, sample: int = SAMPLE) -> dict[int, Codes]:
    """Codes for each length of vectors; learned on the ``sample`` vectors whose ids hash lowest."""
    rows = vectors.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()
    lengths = [r["d"] for r in vectors.select(F.size("embedding").alias("d")).distinct().collect()]
    held = pa.RecordBatch.from_arrays([chosen.column("embedding").combine_chunks()], ["embedding"])
    samples = {d: _matrix(part.column("embedding")) for d, part in _by_length(held)} if held.num_rows else {}
    out = {}
    for d in sorted(lengths):
        own = samples.get(d, np.empty((0, d)))
        out[d] = fitting_codes(own / np.linalg.norm(own, axis=1, keepdims=True), threshold, rows)
    return out


def link_counts(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """vec_id, n, other: in each cell, a vector's links that are first met there, by weight, and one member it is connected with.

    ``vectors`` are those of ``weighed``.
    """
    spark = vectors.sparkSession
    codes = spark.sparkContext.broadcast(learn_codes(vectors, threshold, sample))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_length(batch):
                own = codes.value[dim]
                all_at = own.coordinates(_matrix(part.column("embedding")))
                ids, labels = part.column("vec_id").to_numpy(), part.column("label").to_numpy()
                for lo, hi in own.chunks(all_at):
                    at, keys = all_at[lo:hi], own.keys(all_at[lo:hi])
                    salt = mix(labels[lo:hi].view(np.uint64) + np.uint64(dim))
                    for t in range(own.tables):
                        row, flips = own.probes(at, t)
                        row = np.concatenate([np.arange(hi - lo), row])
                        key = np.concatenate([keys[:, t], keys[row[hi - lo :], t] ^ flips])
                        bucket = mix(salt[row] + np.uint64(t << 32) + key.astype(np.uint64)).view(np.int64)
                        for a in range(0, len(row), 100_000):
                            b = min(a + 100_000, len(row))
                            columns = [pa.array(bucket[a:b]), pa.array(np.full(b - a, t, np.int8)), pa.array(np.arange(a, b) < hi - lo), pa.array(ids[lo:hi][row[a:b]])]
                            yield pa.RecordBatch.from_arrays(columns, ["bucket", "t", "home", "vec_id"])

    entries = written(vectors.mapInArrow(place, "bucket long, t byte, home boolean, vec_id long"), "hamming-entries")
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).filter("n > 1 and homes > 0")
    blocks = F.ceil(F.col("n") / block).cast("int")
    met = entries.join(sizes.select("bucket", blocks.alias("blocks")), "bucket").withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    met = met.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("vec_id", "bucket", "t", "home", "own", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"))
    cells = met.join(vectors, "vec_id").repartition(partitions(spark), "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_cells(batches, ["bucket", "lo", "hi"]):
            for dim, part in _by_length(table):
                yield from _compare(part, codes.value[dim], threshold)

    return cells.mapInArrow(compared, "vec_id long, n long, other long")


def whole_cells(batches: Iterator[pa.RecordBatch], by: list[str], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Sorted batches, dealt anew so that no cell is cut."""
    waiting: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        changes = np.zeros(batch.num_rows, bool)
        for c in by:
            x = batch.column(c).to_numpy()
            changes[1:] |= x[1:] != x[:-1]
            if waiting:
                changes[0] |= bool(waiting[-1].column(c)[-1].as_py() != x[0])
        cuts = np.flatnonzero(changes)
        if len(cuts) and sum(w.num_rows for w in waiting) + cuts[-1] >= rows:
            waiting.append(batch.slice(0, cuts[-1]))
            yield joined()
            waiting = [batch.slice(cuts[-1])]
        else:
            waiting.append(batch)
    if waiting:
        yield joined()


def cell_edges(part: pa.RecordBatch, by: list[str]) -> np.ndarray:
    new = np.ones(part.num_rows, bool)
    new[1:] = np.any([part.column(c).to_numpy()[1:] != part.column(c).to_numpy()[:-1] for c in by], axis=0)
    return np.append(np.flatnonzero(new), part.num_rows)


def pairs_of(edges: np.ndarray, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j within the cells between ``edges``, at most about ``at_once`` at a time."""
    cell_of = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    more = edges[1:][cell_of] - np.arange(edges[-1]) - 1
    sums, lo = np.cumsum(more), 0
    while lo < len(more):
        before = sums[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sums, before + at_once, "right")))
        n = more[lo:hi]
        i = np.repeat(np.arange(lo, min(hi, len(more))), n)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        lo = hi


def _compare(part: pa.RecordBatch, codes: Codes, threshold: float) -> Iterator[pa.RecordBatch]:
    x = _matrix(part.column("embedding"))
    unit = x / np.sqrt((x**2).sum(axis=1))[:, None]
    ids, home, own, t, weight = (part.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "home", "own", "t", "weight"))
    labels = part.column("label").to_numpy()
    edges = cell_edges(part, ["bucket", "lo", "hi"])
    cell_of = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    across = (part.column("lo").to_numpy() != part.column("hi").to_numpy())[edges[:-1]][cell_of]
    at = codes.coordinates(x)
    count, a, b = np.zeros(len(x), np.int64), [], []
    for i, j in pairs_of(edges, PAIRS_AT_ONCE):
        fit = (home[i] | home[j]) & (labels[i] == labels[j]) & (~across[i] | (own[i] != own[j]))
        i, j = i[fit], j[fit]
        near = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
        i, j = i[near], j[near]
        if not len(i):
            continue
        first = codes.first_meeting(at[i], at[j], t[i], home[j], home[i] & home[j], ids[j] < ids[i])
        np.add.at(count, i[first], weight[j[first]])
        np.add.at(count, j[first], weight[i[first]])
        a.append(i), b.append(j)
    if not a:
        return
    root = _forest(np.concatenate(a), np.concatenate(b), len(x))
    told = np.flatnonzero((count > 0) | (root != np.arange(len(x))))
    yield pa.RecordBatch.from_arrays([pa.array(ids[told]), pa.array(count[told]), pa.array(ids[root[told]])], ["vec_id", "n", "other"])


def near_duplicates(embeddings: DataFrame, *, threshold: float = THRESHOLD, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``embeddings``."""
    vectors = written(vectors_of(embeddings), "hamming-vectors")
    classes = written(weighed(vectors), "hamming-classes")
    found = written(link_counts(classes, threshold, sample, block), "hamming-links")
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("vec_id").alias("a"), F.col("other").alias("b")))
    of_class = classes.join(counts, "vec_id", "left").join(roots.withColumnRenamed("id", "vec_id"), "vec_id", "left").select(
        "label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    told = vectors.join(of_class, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    component = F.coalesce("component_id", F.col("vec_id").cast("long"))
    return embeddings.select("vec_id").join(told, "vec_id", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )

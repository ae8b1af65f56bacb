"""Vector code compression: product codebooks learned by Lloyd's rounds with Hamerly's bounds, in integers.

Each component becomes an integer, floor(scale * x), and each vector is cut into equal parts. A part position has
a codebook; Lloyd's rounds assign every part to the nearest entry and then move entries to their parts'
means, rounded down. What a round knows of a vector is a row of a table in the shared folder: for each part
its entry, one *upper* bound of the distance to it and one *lower* bound of the distance to the second nearest.
When entries move, the bounds move by as much. A part whose upper bound lies strictly below the lower one,
or below half the way to the entry's next neighbour, keeps its entry without being looked at; else the upper bound is replaced by the distance
itself; only where that is not enough are all entries scanned, in integers, the lower index first among equals. Bounds are
doubles rounded away from a wrong answer, so they never decide a tie: strictly below means strictly nearer.

A round is one pass over the table, which writes the next, and one aggregation of the sums of parts x entries x positions;
the driver holds the codebooks, whose size depends on the dimension alone. A round's table is removed once the next is there.

Defined results: rows whose vector is null, empty, or holds null or non-finite components are left out, as are
those whose length is not a multiple of the number of parts or differs from that of the first row (the least vec_id). Rows that
repeat a vec_id count each; ids that are equal stand in order of their vectors, null ids last. With fewer rows than entries
a codebook has as many entries as there are rows. Components saturate where a squared distance could leave 64 bits (with parts of 8
beyond about 92,000), sums of errors at 2**63 - 1. An empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.llm._session import dropped, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Labels up to which their sums are broadcast to the rows.
MOST_LABELS = 100_000
#: Bounds are moved outwards by this share, which is more than the rounding of one step.
SLACK = 2.0**-48
#: Rows that a task looks at together.
ROWS = 8192


def _up(x: np.ndarray) -> np.ndarray:
    return x + np.abs(x) * SLACK


def _down(x: np.ndarray) -> np.ndarray:
    return x - np.abs(x) * SLACK


def squared(vectors: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of int64[n, width] to int64[k, width]."""
    top = max(int(np.abs(vectors).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * vectors.shape[1] * top * top < 2**53:  # then all sums are integers that doubles hold
        v, e = vectors.astype(float), entries.astype(float)
        return ((v * v).sum(axis=1)[:, None] - 2 * v @ e.T + (e * e).sum(axis=1)).astype(np.int64)
    out = np.empty((len(vectors), len(entries)), np.int64)
    for k, entry in enumerate(entries):
        out[:, k] = ((vectors - entry) ** 2).sum(axis=1)
    return out


@dataclass
class Bounds:
    """Of n vectors and each of their parts: the entry, the upper and the lower bound."""

    entry: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


@dataclass
class Codebooks:
    """int64[parts, entries, width], and what the bounds need to know of the last move."""

    entries: np.ndarray
    moved: np.ndarray | None = None

    @property
    def half_way(self) -> np.ndarray:
        """Half the distance of each entry to its nearest neighbour, rounded down."""
        out = np.full(self.entries.shape[:2], np.inf)
        for p, entries in enumerate(self.entries):
            if len(entries) > 1:
                d = squared(entries, entries).astype(float)
                np.fill_diagonal(d, np.inf)
                out[p] = _down(np.sqrt(d.min(axis=1)) / 2)
        return out

    def after(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> Codebooks:
        """With the entries at their parts' means, from (part, entry): (how many, sums); those without parts stay."""
        entries = self.entries.copy()
        for (p, k), (n, total) in sums.items():
            entries[p, k] = [x // n for x in total]
        moved = np.sqrt(((entries - self.entries).astype(float) ** 2).sum(axis=2))
        return Codebooks(entries, _up(moved))

    def digest(self) -> str:
        """SHA-256 of the components by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, code: str, scale: float = SCALE) -> list[float]:
        """The vector that a code stands for: the middles of the integers' cells."""
        return [(x + 0.5) / scale for p in range(len(self.entries)) for x in self.entries[p, int(code[2 * p : 2 * p + 2], 16)].tolist()]


def assign(parts: np.ndarray, books: Codebooks, known: Bounds | None, half_way: np.ndarray) -> tuple[Bounds, int]:
    """Each part's nearest entry, the lower index among equals; and how many parts were compared with all entries.

    ``parts`` is int64[n, parts, width]. Without ``known`` bounds all are compared.
    """
    n, count, _ = parts.shape
    out = Bounds(np.zeros((n, count), np.uint8), np.zeros((n, count)), np.full((n, count), np.inf))
    scans = 0
    for p in range(count):
        entries, at = books.entries[p], np.arange(n)
        if known is not None:
            entry, moved = known.entry[:, p].astype(np.int64), books.moved[p]
            upper = _up(known.upper[:, p] + moved[entry])
            others = np.array([np.delete(moved, k).max(initial=0) for k in range(len(entries))])
            lower = _down(known.lower[:, p] - others[entry])
            bar = np.maximum(lower, half_way[p][entry])
            open_ = np.flatnonzero(~(upper < bar))
            exact = ((parts[open_, p] - entries[entry[open_]]) ** 2).sum(axis=1)
            upper[open_] = _up(np.sqrt(exact.astype(float)))
            at = open_[~(upper[open_] < bar[open_])]
            out.entry[:, p], out.upper[:, p], out.lower[:, p] = entry, upper, lower
        if not len(at):
            continue
        scans += len(at)
        d = squared(parts[at, p], entries)
        entry = d.argmin(axis=1)
        row = np.arange(len(at))
        out.entry[at, p], out.upper[at, p] = entry, _up(np.sqrt(d[row, entry].astype(float)))
        if len(entries) > 1:
            d[row, entry] = np.iinfo(np.int64).max
            out.lower[at, p] = _down(np.sqrt(d.min(axis=1).astype(float)))
    return out, scans


def integers(column: pa.Array, scale: float, parts: int) -> np.ndarray:
    """int64[n, parts, width] of a list column whose rows are all of one length."""
    n = len(column)
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    if not n:
        return np.empty((0, parts, 0), np.int64)
    width = len(flat) // n // parts
    most = float(int((2.0**61 / width) ** 0.5 / 2))
    return np.clip(np.floor(flat.astype(float) * scale), -most, most).astype(np.int64).reshape(n, parts, width)


def _lists(flat: np.ndarray, each: int, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, each), pa.int32()), pa.array(flat.ravel(), kind))


def _matrix(column: pa.Array, kind: type, n: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(kind).reshape(n, -1)


STATE = "parts array<int>, entry array<tinyint>, upper array<double>, lower array<double>, scans int"


def _round(rows: DataFrame, books: Codebooks, first: bool, scale: float) -> DataFrame:
    """The state after assigning all parts; from the vectors in the first round, else from the state before."""
    half_way, ids, count = books.half_way, ["vec_id", "label"], len(books.entries)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ids)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                n = batch.num_rows
                if first:
                    parts, known = integers(batch.column("embedding"), scale, count), None
                else:
                    parts = _matrix(batch.column("parts"), np.int64, n).reshape(n, count, -1)
                    known = Bounds(_matrix(batch.column("entry"), np.uint8, n), _matrix(batch.column("upper"), float, n), _matrix(batch.column("lower"), float, n))
                bounds, scans = assign(parts, books, known, half_way)
                each = parts.shape[1] * parts.shape[2]
                state = [_lists(parts, each, pa.int32()), _lists(bounds.entry.astype(np.int8), count, pa.int8()), _lists(bounds.upper, count, pa.float64()), _lists(bounds.lower, count, pa.float64())]
                at_first = np.zeros(n, np.int32)
                at_first[0] = scans
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ids], *state, pa.array(at_first)], [*ids, "parts", "entry", "upper", "lower", "scans"])

    return rows.mapInArrow(assigned, f"{kinds}, {STATE}")


def _sums(state: DataFrame, books: Codebooks) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry): how many parts, and the sums of their components. Tasks add up before anything is shuffled."""
    shape = books.entries.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros(shape[:2], np.int64), np.zeros(shape, np.int64)
        for batch in batches:
            n = batch.num_rows
            parts, entry = _matrix(batch.column("parts"), np.int64, n).reshape(n, shape[0], shape[2]) if n else np.empty((0, shape[0], shape[2])), _matrix(batch.column("entry"), np.int64, n) if n else None
            for p in range(shape[0] if n else 0):
                counts[p] += np.bincount(entry[:, p], minlength=shape[1])
                np.add.at(totals[p], entry[:, p], parts[:, p])
        p, k = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array(counts[p, k]), pa.array(totals[p, k].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "totals"])

    each = state.select("parts", "entry").mapInArrow(summed, "part int, entry int, n long, totals array<long>")
    total = each.select("part", "entry", "n", F.posexplode("totals").alias("position", "total")).groupBy("part", "entry", "position").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(20,0)")).alias("total"))
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in total.orderBy("part", "entry", "position").collect():  # parts x entries x width rows
        out.setdefault((r.part, r.entry), (r.n, []))[1].append(int(r.total))
    return out


def usable(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """vec_id, label and embedding (as doubles) of the rows that take part."""
    held = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = held.filter((F.size("embedding") > 0) & (F.size("embedding") % parts == 0) & finite)
    first = held.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select(F.size("embedding")).limit(1).collect()
    return held.filter(F.size("embedding") == first[0][0]) if first else held.limit(0)


def learn(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> tuple[Codebooks | None, DataFrame]:
    """The codebooks after ``rounds`` rounds, and the state of all parts assigned to them; no codebooks if no row takes part."""
    spark, rows = vectors.sparkSession, usable(vectors, parts)
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").toArrow()
    if not seeds.num_rows:
        ids = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
        return None, spark.createDataFrame([], f"{ids}, {STATE}")
    books = Codebooks(integers(seeds.column(0).combine_chunks(), scale, parts).transpose(1, 0, 2).copy())
    state = written(_round(rows, books, True, scale), "codes-round-0")
    for k in range(1, rounds + 1):
        books = books.after(_sums(state, books))
        before, state = state, written(_round(state, books, False, scale), f"codes-round-{k}")
        dropped(before)
    return books, state


def encode(state: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits for each part) and error, the squared distances of a row's parts together."""
    kinds = ", ".join(f"{c} {state.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    shape = books.entries.shape

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            parts, entry = _matrix(batch.column("parts"), np.int64, n).reshape(n, shape[0], shape[2]), _matrix(batch.column("entry"), np.int64, n)
            error = sum((((parts[:, p] - books.entries[p][entry[:, p]]) ** 2).sum(axis=1).astype(np.uint64) for p in range(shape[0])), np.zeros(n, np.uint64))
            error = np.minimum(error, np.uint64(2**63 - 1)).astype(np.int64)
            codes = [bytes(row).hex() for row in entry.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return state.select("vec_id", "label", "parts", "entry").mapInArrow(coded, f"{kinds}, code string, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> DataFrame:
    """vec_id, code, error, label_error (errors of a label together, nulls as one) and codebooks_sha256."""
    if not 1 <= entries <= 128:
        raise ValueError(f"entries must be 1 to 128, not {entries}")
    books, state = learn(vectors, parts, entries, rounds, scale)
    if books is None:
        return state.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    codes = written(encode(state, books), "codes")
    dropped(state)
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    sums = codes.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(28,0)")).cast("decimal(38,0)"), most).cast("long").alias("label_error")).withColumnRenamed("label", "of")
    sums = written(sums, "codes-labels")
    few = sums.limit(MOST_LABELS + 1).count() <= MOST_LABELS
    joined = codes.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _oracle() -> str:
    parts = f"""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, p, q[p * (len(q) // {PARTS}) + 1 : (p + 1) * (len(q) // {PARTS})] AS q FROM kept, range({PARTS}) t(p)),
book0 AS MATERIALIZED (SELECT p, r - 1 AS k, q AS c FROM parts WHERE r <= {ENTRIES})"""
    near = """near{i} AS MATERIALIZED (SELECT r, p, any_value(q) AS q, min_by(k, d * {n} + k) AS k, min(d) AS d
  FROM (SELECT r, p, k, q, list_sum(list_transform(list_zip(q, c), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS d FROM parts JOIN book{i} USING (p)) GROUP BY r, p)"""
    book = """sums{i} AS MATERIALIZED (SELECT p, k, j, sum(q[j]) AS s, count(*) AS n FROM (SELECT p, k, q, unnest(range(1, len(q) + 1)) AS j FROM near{h}) GROUP BY p, k, j),
book{i} AS MATERIALIZED (SELECT p, k, coalesce(m.c, book{h}.c) AS c FROM book{h} LEFT JOIN
  (SELECT p, k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM sums{i} GROUP BY p, k) m USING (p, k))"""
    steps = [parts]
    for i in range(ROUNDS + 1):
        steps += [*([book.format(i=i, h=i - 1)] if i else []), near.format(i=i, n=ENTRIES)]
    return f"""WITH {", ".join(steps)},
coded AS (SELECT r, string_agg('0' || substr('0123456789abcdef', CAST(k AS INT) + 1, 1), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY r),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS h FROM book{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (r), books
"""


ORACLE = _oracle()

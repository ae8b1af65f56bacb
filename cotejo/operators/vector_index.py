"""An index of reference vectors: coarse centroids, and lists of the vectors nearest to each, in a table that grows.

A list is what lies nearest to one centroid, within one label. The centroids are learned on a bounded sample
(``SAMPLE`` vectors); every vector is indexed, with its angle to the centroid. The table lies sorted by label
and list, so a search that asks for a few lists reads few row groups. New and changed vectors are appended under a
higher version; of each id the highest version counts.

A search sends each query to its nearest lists. It may stop there (``probes`` lists, approximate), or go on
(``exact``): with the k-th best angle so far, the triangle inequality tells which lists, and which of their vectors, can hold
a better one, and only those are looked at. Queries go in blocks of checked size, one after another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.operators.similarity import by_blocks, nearest, unit_rows
from cotejo.sources.scratch import kept

#: Vectors that the centroids are learned on, and how many centroids there are at most.
SAMPLE, MOST_LISTS = 16_384, 1024
ROUNDS = 12
#: Room for rounding: of an angle, and of a cosine that is compared after rounding to ``DIGITS``.
SLACK, DIGITS = 1e-7, 6
ENTRY = "vec_id long, label string, embedding array<double>, lista int, angulo double, version long"


def learn_centroids(vectors: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids by spherical k-means; an empty cluster takes the vector that lies worst."""
    unit = vectors[np.isfinite(vectors).all(axis=1)]
    lists = min(lists, len(unit))
    if not lists:
        return np.zeros((1, vectors.shape[1]))
    centroids = unit[np.random.default_rng(11).permutation(len(unit))[:lists]].copy()
    for _ in range(rounds):
        scores = unit @ centroids.T
        at, best = scores.argmax(axis=1), scores.max(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, unit)
        empty = np.flatnonzero(np.bincount(at, minlength=lists) == 0)
        sums[empty] = unit[np.argsort(best, kind="stable")[: len(empty)]]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centroids)
    return centroids


@dataclass(frozen=True)
class VectorIndex:
    """The tables at ``path`` and the centroids, one matrix for each length of vectors."""

    spark: SparkSession
    path: str
    centroids: dict[int, np.ndarray]

    def entries(self) -> DataFrame:
        """The indexed vectors: of each id the one of the highest version."""
        stored = self.spark.read.schema(ENTRY).parquet(f"{self.path}/listas")
        try:
            replaced = self.spark.read.schema("vec_id long, version long").parquet(f"{self.path}/cambios")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return stored
        newest = replaced.groupBy("vec_id").agg(F.max("version").alias("newest"))
        return stored.join(newest, "vec_id", "left").filter("newest is null or version = newest").drop("newest")

    def add(self, vectors: DataFrame, version: int) -> None:
        """Appends (vec_id, label, embedding); ids that are there already change. ``version`` is higher than all before."""
        frozen = self.spark.sparkContext.broadcast(self.centroids)
        columns = ["vec_id", "label", "embedding"]

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists, angles = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
                for dim, row, unit in unit_rows(batch.column("embedding")):
                    known = frozen.value.get(dim)
                    if known is not None:
                        scores = unit @ known.T
                        lists[row] = np.nan_to_num(scores, nan=-1).argmax(axis=1)
                        angles[row] = np.arccos(np.clip(scores[np.arange(len(row)), lists[row]], -1, 1))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(lists), pa.array(angles, from_pandas=True), pa.array(np.full(batch.num_rows, version))], [*columns, "lista", "angulo", "version"])

        usable = vectors.filter("vec_id is not null and label is not null and size(embedding) > 0").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
        added = usable.mapInArrow(placed, ENTRY)
        try:
            before = self.spark.read.schema(ENTRY).parquet(f"{self.path}/listas").select("vec_id").distinct()
            changed = usable.select("vec_id").join(before, "vec_id", "left_semi").withColumn("version", F.lit(version).cast("long"))
            changed.write.mode("append").parquet(f"{self.path}/cambios")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        added.repartitionByRange("label", "lista").sortWithinPartitions("label", "lista").write.mode("append").parquet(f"{self.path}/listas")

    def search(self, queries: DataFrame, k: int = 5, probes: int = 8, exact: bool = True) -> DataFrame:
        """vec_id, ref_id, similitud and lugar: the ``k`` nearest vectors of the query's label, of all if ``exact``, else of its ``probes`` nearest lists.

        How many probes find enough depends on the vectors: see ``probes_for``.
        """
        entries = self.entries()
        asked = queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).filter("label is not null and size(embedding) > 0")
        spans = entries.groupBy("label", "lista").agg(F.min("angulo").alias("lo"), F.max("angulo").alias("hi"))

        def of_block(block: DataFrame) -> DataFrame:
            held = block.withColumn("least", F.lit(None).cast("double")).toArrow()
            first = kept(nearest(_scan(entries, self._plan(held, probes, None), k), k, "vec_id", "ref_id"), "index-first")
            if not exact:
                return first
            worst = first.groupBy("vec_id").agg(F.min("similitud").alias("least"), F.count("*").alias("n")).filter(F.col("n") >= k).drop("n")
            again = block.join(worst, "vec_id", "left").toArrow()
            more = _scan(entries, self._plan(again, probes, spans), k)
            return nearest(first.drop("lugar").unionByName(more), k, "vec_id", "ref_id")

        return by_blocks(asked, of_block)

    def probes_for(self, queries: DataFrame, k: int = 5, share: float = 0.9) -> int:
        """The least power of two of probes that finds ``share`` of the ``k`` nearest of ``queries`` in every label, measured against exact search."""
        labels = queries.select("vec_id", F.col("label").cast("string").alias("label"))
        truth, probes = kept(self.search(queries, k), "index-truth"), 1
        most = max((len(c) for c in self.centroids.values()), default=1)
        while probes < most:
            worst = recall(self.search(queries, k, probes, exact=False), truth, labels).agg(F.min("recall")).first()[0]
            if worst is None or worst >= share:
                break
            probes *= 2
        return min(probes, most)

    def _plan(self, held: pa.Table, probes: int, spans: DataFrame | None) -> Plan:
        """Which lists each query goes to: the nearest ones first; then, by ``spans``, all others that may hold a better vector."""
        unit: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        column = held.column("embedding").combine_chunks()
        n = len(column)
        lists, angles = [np.empty(0, np.int64)] * n, np.full((n, max((len(c) for c in self.centroids.values()), default=1)), np.nan)
        ranges: dict[str, list[tuple]] = {}
        if spans is not None:  # labels times lists at most
            for r in spans.toLocalIterator():
                ranges.setdefault(r.label, []).append((r.lista, r.lo, r.hi))
        limits = {label: np.array(found).T for label, found in ranges.items()}
        labels = held.column("label").to_pylist()
        reach = _reach(held.column("least").to_numpy()) if spans is not None else np.full(n, np.inf)
        for dim, row, x in unit_rows(column):
            unit[dim] = row, x
            known = self.centroids.get(dim)
            if known is None:
                continue
            scores = np.nan_to_num(x @ known.T, nan=-1.0)
            angles[row, : len(known)] = np.arccos(np.clip(scores, -1, 1))
            order = np.argsort(-scores, axis=1, kind="stable")
            for place, q in enumerate(row.tolist()):
                near, rest = order[place, :probes], order[place, probes:]
                if spans is None:
                    lists[q] = near
                    continue
                c, lo, hi = limits.get(labels[q], np.empty((3, 0)))
                own = angles[q, c.astype(int)]
                lists[q] = np.intersect1d(rest, c[(own - hi <= reach[q]) & (lo - own <= reach[q])].astype(int))
        return Plan(held.column("vec_id").to_numpy(), labels, unit, lists, angles, reach)


def _reach(least: np.ndarray) -> np.ndarray:
    """The largest angle whose cosine, rounded, may be ``least``; all angles where nothing is known yet."""
    known = np.arccos(np.clip(np.asarray(least, float) - 10.0**-DIGITS, -1, 1)) + SLACK
    return np.where(np.isnan(known), np.inf, known)


@dataclass(frozen=True)
class Plan:
    """A block of queries: ids, labels, unit vectors by length (rows, matrix), lists to read, angles to centroids, and how far a better vector lies at most."""

    ids: np.ndarray
    labels: list
    unit: dict[int, tuple[np.ndarray, np.ndarray]]
    lists: list[np.ndarray]
    angles: np.ndarray
    reach: np.ndarray


def _scan(entries: DataFrame, plan: Plan, k: int) -> DataFrame:
    """Each task's ``k`` best vectors for each query, from the lists that the query goes to."""
    by_list: dict[tuple, np.ndarray] = {}
    for q, lists in enumerate(plan.lists):
        for c in lists.tolist():
            by_list.setdefault((plan.labels[q], c), []).append(q)
    frozen = entries.sparkSession.sparkContext.broadcast((plan, by_list))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, by_list = frozen.value
        place = {dim: dict(zip(rows.tolist(), range(len(rows)), strict=True)) for dim, (rows, _) in plan.unit.items()}
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            ids, angle = batch.column("vec_id").to_numpy(), batch.column("angulo").to_numpy(zero_copy_only=False)
            keys = list(zip(batch.column("label").to_pylist(), batch.column("lista").to_pylist(), strict=True))
            for dim, row, x in unit_rows(batch.column("embedding")):
                if dim not in place:
                    continue
                groups: dict[tuple, list[int]] = {}
                for at, r in enumerate(row.tolist()):
                    groups.setdefault(keys[r], []).append(at)
                for key, members in groups.items():
                    asked = [q for q in by_list.get(key, ()) if q in place[dim]]
                    if not asked:
                        continue
                    near = np.abs(plan.angles[asked, key[1]][:, None] - angle[row[members]][None, :]) <= plan.reach[asked][:, None]
                    wanted = near.any(axis=0) | np.isnan(angle[row[members]])
                    members = np.array(members)[wanted]
                    if not len(members):
                        continue
                    scores = np.round(plan.unit[dim][1][[place[dim][q] for q in asked]] @ x[members].T, DIGITS) + 0.0
                    other = ids[row[members]]
                    scores[(plan.ids[asked][:, None] == other[None, :]) | np.isnan(scores)] = -np.inf
                    for i, q in enumerate(asked):
                        before = found.get(q, (np.empty(0), np.empty(0, np.int64)))
                        s, r = np.concatenate([before[0], scores[i]]), np.concatenate([before[1], other])
                        top = np.lexsort((r, -s))[:k]
                        found[q] = s[top], r[top]
        for q, (s, r) in found.items():
            ok = np.isfinite(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(int(ok.sum()), plan.ids[q])), pa.array(r[ok]), pa.array(s[ok])], ["vec_id", "ref_id", "similitud"])

    # what no query asks for is left out by the reader, which skips whole row groups
    read = entries.filter(F.col("lista").isin(sorted({c for _, c in by_list})) & F.col("label").isin(sorted({a for a, _ in by_list})))
    return read.mapInArrow(best, "vec_id long, ref_id long, similitud double")


def build_index(vectors: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE, version: int = 0) -> VectorIndex:
    """An index of ``vectors`` (vec_id, label, embedding) at ``path``; about the square root of their number of lists, if none is given."""
    spark = vectors.sparkSession
    usable = vectors.filter("vec_id is not null and label is not null and size(embedding) > 0")
    count = usable.count()
    wanted = lists or int(np.clip(round(count**0.5), 1, MOST_LISTS))
    chosen = usable.select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()
    centroids = {dim: learn_centroids(x, wanted) for dim, _, x in unit_rows(chosen.column(0).combine_chunks())} if chosen.num_rows else {}
    flat = [(dim, k, c.tolist()) for dim, matrix in centroids.items() for k, c in enumerate(matrix)]
    spark.createDataFrame(flat, "ancho int, lista int, centro array<double>").write.parquet(f"{path}/centros")
    index = VectorIndex(spark, path, centroids)
    index.add(vectors, version)
    return index


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """The index that ``build_index`` wrote at ``path``."""
    rows = spark.read.parquet(f"{path}/centros").orderBy("ancho", "lista").collect()  # MOST_LISTS of each length at most
    widths = sorted({r.ancho for r in rows})
    return VectorIndex(spark, path, {w: np.array([r.centro for r in rows if r.ancho == w]) for w in widths})


def recall(found: DataFrame, truth: DataFrame, by: DataFrame | None = None) -> DataFrame:
    """The share of true neighbours found; for each label if ``by`` (vec_id, label) tells the queries' labels."""
    hits = truth.select("vec_id", "ref_id").join(found.select("vec_id", "ref_id", F.lit(1).alias("hit")), ["vec_id", "ref_id"], "left")
    labelled = hits.join(by, "vec_id") if by is not None else hits.withColumn("label", F.lit(None).cast("string"))
    return labelled.groupBy("label").agg(F.count("*").alias("verdaderos"), (F.count("hit") / F.count("*")).alias("recall"))

"""Similarity of submissions with references: dense vectors, tokens, sets and fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cotejo.functions import winnow
from cotejo.functions.style import runs
from cotejo.functions.vectors import cosine, jaccard
from cotejo.sources.scratch import kept

#: References that a kernel may hold: rows times width of the matrix, 64 MB of doubles.
KERNEL_CELLS = 8 << 20


def nearest(pairs: DataFrame, k: int, by: str, reference: str, score: str = "similitud") -> DataFrame:
    """The ``k`` best pairs of each ``by``, ties by reference id, with their place."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), reference))
    return pairs.withColumn("lugar", place).filter(F.col("lugar") <= k)


def _kernel_fits(references: DataFrame, width: int) -> bool:
    most = KERNEL_CELLS // max(1, width)
    return references.limit(most + 1).count() <= most


def vector_search(queries: DataFrame, vectors: DataFrame, k: int = 5, digits: int = 6) -> DataFrame:
    """vec_id, ref_id, similitud and lugar: the ``k`` nearest vectors of the same label.

    ``queries`` is the stated, small side: in blocks that fit a kernel it is sent to all tasks,
    each of which keeps its best ``k`` for each query, so that no pair is shuffled.
    """
    return by_blocks(queries, lambda block: nearest(_best_of_block(block, vectors, k, digits), k, "vec_id", "ref_id"))


def pairs_above(queries: DataFrame, vectors: DataFrame, least: float, digits: int = 6) -> DataFrame:
    """vec_id, ref_id and similitud: all vectors of a query's label with a rounded cosine of ``least`` or more.

    Queries go to the vectors in blocks, as in ``vector_search``; only pairs that are close enough become rows.
    """
    local = vectors.filter(F.col("label").isNotNull()).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))

    def of_block(block: DataFrame) -> DataFrame:
        frozen = block.sparkSession.sparkContext.broadcast(block.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).toArrow())

        def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = frozen.value
            ids, labels = table.column("vec_id").to_numpy(), table.column("label").to_numpy(zero_copy_only=False)
            asked = list(unit_rows(table.column("embedding").combine_chunks()))
            for batch in batches:
                other, other_label = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(zero_copy_only=False)
                for dim, row, x in unit_rows(batch.column("embedding")):
                    for wide, q, unit in asked:
                        if wide != dim:
                            continue
                        for lo in range(0, len(q), 1024):  # so many queries at once
                            mine = q[lo : lo + 1024]
                            scores = np.round(unit[lo : lo + 1024] @ x.T, digits) + 0.0
                            i, j = np.nonzero((scores >= least) & (labels[mine][:, None] == other_label[row][None, :]) & (ids[mine][:, None] != other[row][None, :]))
                            yield pa.RecordBatch.from_arrays([pa.array(ids[mine[i]]), pa.array(other[row[j]]), pa.array(scores[i, j])], ["vec_id", "ref_id", "similitud"])

        return local.mapInArrow(close, "vec_id long, ref_id long, similitud double")

    return by_blocks(queries, of_block)


def by_blocks(queries: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``run`` for each block of queries that fits a kernel, one after another.

    The driver holds one block at a time: of several, each block's result is written before the next is read.
    """
    blocks = _query_blocks(queries)
    if len(blocks) == 1:
        return run(blocks[0])
    return reduce(DataFrame.unionByName, [kept(run(block), "query-block") for block in blocks])


def _query_blocks(queries: DataFrame) -> list[DataFrame]:
    """The queries in as many parts as it takes for each to fit a kernel, by the hashes of their ids."""
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    parts = -(-size["n"] * max(1, size["width"] or 1) // max(1, KERNEL_CELLS // 2)) or 1  # with room for parts of unequal size
    if parts == 1:
        return [queries]
    return [queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == b) for b in range(parts)]


def _best_of_block(queries: DataFrame, vectors: DataFrame, k: int, digits: int) -> DataFrame:
    """The ``k`` best of each task's vectors for each query of a block."""
    kinds = "vec_id long, ref_id long, similitud double"
    held = queries.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).toArrow()
    frozen = queries.sparkSession.sparkContext.broadcast(held)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = frozen.value
        ids, labels = table.column("vec_id").to_numpy(), table.column("label").to_numpy()
        unit = _unit(table.column("embedding").combine_chunks())
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            other, other_label = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(zero_copy_only=False)
            x = _unit(batch.column("embedding"))
            for label in np.unique(labels):
                q, v = np.flatnonzero(labels == label), np.flatnonzero(other_label == label)
                if not len(v):
                    continue
                scores = np.round(unit[q] @ x[v].T, digits) + 0.0
                scores[ids[q][:, None] == other[v][None, :]] = -np.inf
                for row, query in enumerate(q.tolist()):
                    before = kept.get(query, (np.empty(0), np.empty(0, np.int64)))
                    s, r = np.concatenate([before[0], scores[row]]), np.concatenate([before[1], other[v]])
                    top = np.lexsort((r, -s))[:k]
                    kept[query] = s[top], r[top]
        for query, (s, r) in kept.items():
            ok = np.isfinite(s)
            n = int(ok.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, ids[query])), pa.array(r[ok]), pa.array(s[ok])], ["vec_id", "ref_id", "similitud"])

    local = vectors.filter(F.col("label").isNotNull()).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    return local.mapInArrow(best, kinds)


def mean_distances(queries: DataFrame, vectors: DataFrame, digits: int = 5) -> DataFrame:
    """vec_id, label, coseno and distancia: each query's mean cosine with, and Euclidean distance to, the other vectors of each label.

    Each task adds up its own vectors, so what is shuffled is one row for each task, query and label.
    Pairs without a cosine count for the distance only.
    """

    def sums(block: DataFrame) -> DataFrame:
        held = block.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).toArrow()
        frozen = block.sparkSession.sparkContext.broadcast(held)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = frozen.value
            ids, column = table.column("vec_id").to_numpy(), table.column("embedding").combine_chunks()
            unit, plain = _unit(column), _rows_of(column)
            total: dict[object, np.ndarray] = {}
            for batch in batches:
                other, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_pylist()
                for label in dict.fromkeys(labels):
                    v = np.flatnonzero([x == label for x in labels])
                    column = batch.column("embedding").take(pa.array(v))
                    apart = ids[:, None] != other[v][None, :]
                    scores = unit @ _unit(column).T
                    x = _rows_of(column)
                    gaps = np.sqrt(np.maximum((plain**2).sum(axis=1)[:, None] + (x**2).sum(axis=1)[None, :] - 2 * plain @ x.T, 0))
                    has = apart & np.isfinite(scores)
                    own = total.setdefault(label, np.zeros((4, len(ids))))
                    own += [np.where(has, scores, 0).sum(axis=1), has.sum(axis=1), np.where(apart, gaps, 0).sum(axis=1), apart.sum(axis=1)]
            for label, (cosines, n, gaps, m) in total.items():
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([label] * len(ids), label_type), *map(pa.array, (cosines, n, gaps, m))], ["vec_id", "label", "c", "n", "g", "m"])

        return local.mapInArrow(add, f"vec_id long, label {vectors.schema['label'].dataType.simpleString()}, c double, n double, g double, m double")

    local = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    label_type = to_arrow_type(vectors.schema["label"].dataType)
    summed = by_blocks(queries, sums).groupBy("vec_id", "label").agg(*[F.sum(c).alias(c) for c in "cngm"])
    mean = lambda a, b: F.round(F.try_divide(a, b), digits)
    return summed.filter("m > 0").select("vec_id", "label", mean(F.col("c"), F.col("n")).alias("coseno"), mean(F.col("g"), F.col("m")).alias("distancia"))


def link_counts(vectors: DataFrame, least: float, digits: int = 6, block: int = 1024) -> DataFrame:
    """vec_id and n_links of every vector: how many others of its label have a rounded cosine of ``least`` or more.

    Each label is cut into blocks of about ``block`` vectors and every pair of blocks is compared
    once, in a task of its own. A vector without a label, length or direction has no links.
    """
    usable = vectors.filter("vec_id is not null and label is not null and size(embedding) > 0").select(
        "vec_id", "label", F.size("embedding").alias("width"), F.col("embedding").cast("array<double>").alias("embedding"), F.xxhash64("vec_id", "embedding").alias("dealt")
    )
    blocks = usable.groupBy("label", "width").agg(F.ceil(F.count("*") / block).alias("blocks"))
    placed = usable.join(blocks, ["label", "width"]).withColumn("block", F.pmod("dealt", "blocks"))
    paired = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    cells = paired.select("vec_id", "label", "width", "embedding", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

    def count(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        ids, own, x = cell.column("vec_id").to_numpy(), cell.column("block").to_numpy(), _unit(cell.column("embedding").combine_chunks())
        lo, hi = cell.column("lo")[0].as_py(), cell.column("hi")[0].as_py()
        a, b = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        linked = (np.round(x[a] @ x[b].T, digits) >= least) & (ids[a][:, None] != ids[b][None, :])
        n = np.zeros(len(ids), np.int64)
        n[a] = linked.sum(axis=1)
        if lo != hi:
            n[b] = linked.sum(axis=0)
        return pa.table({"vec_id": pa.array(ids), "n_links": pa.array(n)})

    found = cells.groupBy("label", "width", "lo", "hi").applyInArrow(count, "vec_id long, n_links long")
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links")).unionByName(found).groupBy("vec_id").agg(F.sum("n_links").alias("n_links"))


def _rows_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(column: pa.Array) -> np.ndarray:
    x = _rows_of(column)
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.linalg.norm(x, axis=1, keepdims=True)


def unit_rows(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, rows and unit vectors of each length that a list column holds; a vector without a direction becomes NaN."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths[lengths > 0]):
        row = np.flatnonzero(lengths == dim)
        yield int(dim), row, _unit(column.take(pa.array(row)))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def token_vectors(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, token, n and norm: the sparse token counts of each text."""
    counts = texts.select(key, F.explode(tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(key)
    return counts.withColumn("norm", F.sqrt(F.sum((F.col("n") * F.col("n")).cast("double")).over(whole)))


def best_reference(submissions: DataFrame, references: DataFrame, *, key: str = "doc_id", reference: str = "item_id", digits: int = 6) -> DataFrame:
    """Every submission with its most similar reference by cosine of token counts, ties by id.

    The references' count matrix goes to all tasks, in as many blocks of references as it takes for each to fit a kernel;
    of several blocks each one's best are written before the next is read. A submission without a token of any reference has a null reference and similarity 0.
    """
    refs = token_vectors(references, reference).select(F.col(reference).alias("referencia"), "token", "n", "norm")
    size = refs.agg(F.count_distinct("token").alias("t"), F.count_distinct("referencia").alias("r")).first()
    blocks = -(-size["t"] * max(1, size["r"]) // KERNEL_CELLS) or 1
    if blocks == 1:
        return _best_of_references(submissions, references, refs, key, reference, digits)
    own = F.pmod(F.xxhash64("referencia"), F.lit(blocks))
    found = [kept(_best_of_references(submissions, references, refs.filter(own == b), key, reference, digits).filter("referencia is not null"), "reference-block") for b in range(blocks)]
    order = F.struct((-F.col("similitud")).alias("s"), F.col("referencia").alias("r"))
    best = reduce(DataFrame.unionByName, found).groupBy(key).agg(F.min_by(F.struct("referencia", "similitud"), order).alias("x")).select(key, "x.*")
    return submissions.select(key).join(best, key, "left").fillna({"similitud": 0.0})


def _best_of_references(submissions: DataFrame, references: DataFrame, refs: DataFrame, key: str, reference: str, digits: int) -> DataFrame:
    """The best of the references whose token counts are ``refs``, which fit a kernel."""
    frozen = submissions.sparkSession.sparkContext.broadcast(_matrix_of(refs.toArrow()))
    id_type, ref_type = submissions.schema[key].dataType.simpleString(), references.schema[reference].dataType.simpleString()

    def best_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, ids, matrix, norms = frozen.value
        for batch in batches:
            sims, where = _cosines(batch.column("words"), vocabulary, matrix, norms)
            sims = np.round(sims, digits)
            at = sims.argmax(axis=1) if len(ids) else np.zeros(len(sims), np.int64)
            top = sims[np.arange(len(at)), at] if len(ids) else np.zeros(len(at))
            chosen = ids.take(pa.array(at)) if len(ids) else pa.nulls(len(at), ids.type)
            none = pa.array(~where | (top <= 0))
            yield pa.RecordBatch.from_arrays([batch.column(key), pc.if_else(none, pa.nulls(len(at), ids.type), chosen), pa.array(np.maximum(top, 0.0))], [key, "referencia", "similitud"])

    words = submissions.select(key, F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("words"))
    return words.mapInArrow(best_of, f"{key} {id_type}, referencia {ref_type}, similitud double")


def _matrix_of(refs: pa.Table) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """Vocabulary, reference ids in order, counts[token, reference] and norms."""
    refs = refs.combine_chunks()
    codes = refs.column("token").combine_chunks().dictionary_encode() if refs.num_rows else pa.array([], pa.string()).dictionary_encode()
    ids = pc.array_sort_indices(refs.column("referencia").combine_chunks().unique()) if refs.num_rows else None
    ordered = refs.column("referencia").combine_chunks().unique().take(ids) if refs.num_rows else pa.array([], refs.schema.field("referencia").type)
    matrix = np.zeros((len(codes.dictionary), len(ordered)))
    place = pc.index_in(refs.column("referencia"), ordered).to_numpy() if refs.num_rows else np.empty(0, np.int64)
    matrix[codes.indices.to_numpy(), place] = refs.column("n").to_numpy()
    return codes.dictionary, ordered, matrix, np.sqrt((matrix**2).sum(axis=0))


def _cosines(words: pa.Array, vocabulary: pa.Array, matrix: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """similarity[text, reference], and which texts share a token with any."""
    n = len(words)
    out, shares = np.zeros((n, matrix.shape[1])), np.zeros(n, bool)
    flat = words.flatten().dictionary_encode()
    if not len(flat) or not matrix.size:
        return out, shares
    row = np.repeat(np.arange(n), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    key, count = np.unique(row * len(flat.dictionary) + flat.indices.to_numpy(), return_counts=True)
    row, code = np.divmod(key, len(flat.dictionary))
    own = np.sqrt(np.bincount(row, weights=count.astype(float) ** 2, minlength=n))
    term = pc.fill_null(pc.index_in(flat.dictionary, vocabulary), -1).to_numpy()[code]
    known = term >= 0
    row, term, count = row[known], term[known], count[known]
    edges = np.searchsorted(row, np.arange(n + 1))
    for k in range(n):
        mine = slice(edges[k], edges[k + 1])
        if edges[k + 1] > edges[k]:
            out[k] = count[mine] @ matrix[term[mine]] / (own[k] * norms)
            shares[k] = True
    return out, shares


def token_jaccard(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str) -> DataFrame:
    return left.join(right, on).withColumn("jaccard", F.round(jaccard(F.array_distinct(a), F.array_distinct(b)), 6))


def shared_tokens(queries: DataFrame, texts: DataFrame, query_id: str, text_id: str) -> DataFrame:
    """Jaccard similarity of the token sets of each query and each text it shares a token with.

    Pairs come from an inverted index that holds the queries' tokens only.
    """

    def sets(df: DataFrame, key: str) -> DataFrame:
        return df.select(F.col(key), F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))

    mine, theirs = sets(queries, query_id), sets(texts, text_id)
    sizes = lambda df, key, name: df.groupBy(key).agg(F.count("*").alias(name))
    if _kernel_fits(mine, 64):
        joined = theirs.join(F.broadcast(mine), "token")
    else:
        # a common token's texts then meet its queries where those are, not in one task
        joined = mine.join(F.broadcast(theirs) if _kernel_fits(theirs, 64) else theirs, "token")
    shared = joined.groupBy(query_id, text_id).agg(F.count("*").alias("shared"))
    sized = shared.join(sizes(mine, query_id, "n"), query_id).join(sizes(theirs, text_id, "m"), text_id)
    return sized.select(query_id, text_id, F.round(F.col("shared") / (F.col("n") + F.col("m") - F.col("shared")), 6).alias("jaccard"))


def ngrams(words: Column, n: int) -> Column:
    return runs(words, n, lambda xs: F.concat_ws(" ", *xs))


def fingerprints(texts: DataFrame, key: str, k: int = 5, window: int = 4) -> DataFrame:
    """key and fingerprint: hashes of k-grams of characters without white space, by winnowing.

    In each run of ``window`` hashes the least is chosen, and each chosen one is kept once for a
    text. Texts with fewer hashes than a window have their least one.
    """
    kind = texts.schema[key].dataType.simpleString()

    def winnowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for of, chosen in winnow.fingerprints(batch.column("text"), k, window):
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(of)), pa.array(chosen)], [key, "fingerprint"])

    return texts.select(key, F.lower("text").alias("text")).mapInArrow(winnowed, f"`{key}` {kind}, fingerprint long")


def shared_fingerprints(texts: DataFrame, references: DataFrame, a: str, b: str) -> DataFrame:
    """a, b and n: how many fingerprints each text shares with each reference. References that fit go to the texts, which are not shuffled then."""
    joined = texts.join(F.broadcast(references) if _kernel_fits(references, 64) else references, "fingerprint")
    return joined.groupBy(a, b).agg(F.count("*").alias("n"))

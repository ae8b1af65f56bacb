"""Language identification by prediction by partial matching (PPM).

For every language a variable-order byte context tree is learned: how often each
byte follows each context of up to ``ORDER`` bytes. A byte costs its code length
under the longest context that has seen it; each context that has not costs an
escape first (method C: an escape counts as often as the context has different
bytes). The statistics are frozen while scoring, so the code length of a byte
depends on it and the ``ORDER`` bytes before it only, and is computed once for
every different (ORDER+1)-gram of a chunk of texts. The language with the
shortest code for the whole text is predicted.

The trees are learned from a bounded sample of labelled rows: for each language
the ``SAMPLE`` rows whose ids hash lowest, their texts whole. Spark counts the sample's
(ORDER+1)-grams; the driver gets these counts, never a text.

The score compares learned languages only. Whether any of them fits is told by the
bits a byte: all labelled rows are coded under their own language's tree, and a
histogram that Spark counts gives each language's median and spread. A text whose code
is longer than the median by more than ``LEAST_EXCESS + EXCESS_WIDTH * spread / sqrt(bytes)``
is in no learned language for ``keep_identified``. Texts that a tree was learned from
have shorter codes than others, so they count only where others are fewer than ``FEW``;
then the learned ones are coded under trees of the other half of the sample.

Defined results: a text that is null or has no letter is ``und`` with score 0, as
is every text where no language could be learned; a null id is never learned
from; rows without a language are scored, not learned from; repeated rows are
scored one by one; only the named columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cotejo.llm._session import written
from cotejo.llm._text import strings, text_chunks

ORDER = 3
SAMPLE = 300
#: Bytes of text scored at once; the arrays for them take some sixty times as much.
CHUNK_BYTES = 1 << 20
UNDETERMINED = "und"
#: Bits a byte above a language's median that are always allowed, and spreads beside them, for short texts.
LEAST_EXCESS, EXCESS_WIDTH = 1.0, 6.0
#: Steps of bits a byte in the histogram, and how many unlearned texts a bound needs.
STEP, FEW = 0.01, 20


def grams(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The (order+1)-gram that ends at each byte, as an integer; zero bytes stand before a text."""
    out = data.astype(np.uint32)
    at = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, order + 1):
        before = np.zeros(len(data), np.uint32)
        before[k:] = data[:-k]
        before[at < k] = 0
        out |= before << np.uint32(8 * k)
    return out


@dataclass
class ContextTree:
    """Counts of bytes after contexts; one pair of sorted arrays for each order."""

    symbols: list[np.ndarray]  # (context, byte) of order k as an integer
    symbol_counts: list[np.ndarray]
    contexts: list[np.ndarray]
    totals: list[np.ndarray]
    distinct: list[np.ndarray]

    @classmethod
    def learn(cls, texts: list[str], order: int = ORDER) -> ContextTree:
        data, offsets = strings(pa.array(texts, pa.string()))
        return cls.of_counts(*np.unique(grams(data, offsets, order), return_counts=True), order)

    @classmethod
    def of_counts(cls, full: np.ndarray, n: np.ndarray, order: int = ORDER) -> ContextTree:
        """The tree of texts in which the different (order+1)-grams ``full`` stand so often."""
        tree = cls([], [], [], [], [])
        for k in range(order + 1):
            own = full if k == 3 else full & np.uint32((1 << (8 * (k + 1))) - 1)
            symbols, where = np.unique(own, return_inverse=True)
            counts = np.bincount(where.ravel(), weights=n, minlength=len(symbols)).astype(np.int64)
            contexts, first, distinct = np.unique(symbols >> np.uint32(8), return_index=True, return_counts=True)
            totals = np.add.reduceat(counts, first) if len(first) else counts
            for name, x in zip(("symbols", "symbol_counts", "contexts", "totals", "distinct"), (symbols, counts, contexts, totals, distinct), strict=True):
                getattr(tree, name).append(x)
        return tree

    def code_lengths(self, wanted: np.ndarray) -> np.ndarray:
        """Bits for the last byte of each gram in ``wanted``."""
        order = len(self.symbols) - 1
        bits = np.zeros(len(wanted))
        open_ = np.arange(len(wanted))
        for k in range(order, -1, -1):
            if not len(self.contexts[k]):
                continue
            own = wanted[open_] if k == 3 else wanted[open_] & np.uint32((1 << (8 * (k + 1))) - 1)
            c, known = _find(self.contexts[k], own >> np.uint32(8))
            s, seen = _find(self.symbols[k], own)
            mass = self.totals[k][c] + self.distinct[k][c]
            bits[open_[seen]] -= np.log2(self.symbol_counts[k][s[seen]] / mass[seen])
            escaped = known & ~seen
            bits[open_[escaped]] -= np.log2(self.distinct[k][c[escaped]] / mass[escaped])
            open_ = open_[~seen]
        bits[open_] += 8  # a byte that no context knows
        return bits


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """lang, half and text of at most ``sample`` labelled rows for each language, rows that repeat an id aside."""
    usable = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").filter(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    # only ids are ranked; the texts of those chosen are fetched by a join with that bounded list
    chosen = usable.select("doc_id", "lang").withColumn("place", place).filter(F.col("place") <= sample)
    chosen = chosen.groupBy("doc_id", "lang").agg(F.min(F.col("place") % 2).alias("half"))
    return written(usable.join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "half", "text"), "language-sample")


#: For each language and half of its sample: different grams and how often they come.
Counts = dict[str, dict[int, tuple[np.ndarray, np.ndarray]]]


def count_sample(sample: DataFrame) -> Counts:
    """The grams of the sample; as many rows come to the driver as it has different ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, half in set(zip(batch.column("lang").to_pylist(), batch.column("half").to_pylist(), strict=True)):
                mine = batch.filter(pc.and_(pc.equal(batch.column("lang"), lang), pc.equal(batch.column("half"), half)))
                for _, data, offsets in text_chunks(mine, "text", CHUNK_BYTES):
                    gram, n = np.unique(grams(data, offsets), return_counts=True)
                    columns = [pa.array([lang] * len(gram), pa.string()), pa.array(np.full(len(gram), half, np.int32)), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "half", "gram", "n"])

    rows = sample.mapInArrow(count, "lang string, half int, gram long, n long").groupBy("lang", "half", "gram").agg(F.sum("n").alias("n")).toArrow()
    out: Counts = {lang: {} for lang in sorted(r["lang"] for r in sample.select("lang").distinct().collect())}
    for lang in out:
        own = rows.filter(pc.equal(rows.column("lang"), lang))
        for half in (0, 1):
            part = own.filter(pc.equal(own.column("half"), half))
            if part.num_rows:
                gram = part.column("gram").to_numpy().astype(np.uint32)
                order = np.argsort(gram)
                out[lang][half] = gram[order], part.column("n").to_numpy()[order]
    return out


def tree_of(parts: list[tuple[np.ndarray, np.ndarray]]) -> ContextTree:
    if not parts:
        return ContextTree.of_counts(np.empty(0, np.uint32), np.empty(0, np.int64))
    gram, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return ContextTree.of_counts(gram, np.bincount(where.ravel(), weights=np.concatenate([n for _, n in parts]), minlength=len(gram)).astype(np.int64))


def score_languages(trees: dict[str, ContextTree], batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
    """For each row: the columns ``keep``, lang_pred, score and bits for each byte."""
    names = sorted(trees)
    for batch in batches:
        for part, data, offsets in text_chunks(batch, "text", CHUNK_BYTES):
            n = len(part)
            total = np.zeros((n, max(1, len(names))))
            full = np.flatnonzero(np.diff(offsets))
            if len(data) and names:
                wanted, where = np.unique(grams(data, offsets), return_inverse=True)
                for k, name in enumerate(names):
                    each = trees[name].code_lengths(wanted)[where]
                    total[full, k] = np.add.reduceat(each, offsets[full])
            letters = pc.fill_null(pc.match_substring_regex(part.column("text"), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            best = total.argmin(axis=1)
            # what a uniform prior over the languages leaves to the shortest code
            odds = np.exp2(np.clip(total[np.arange(n), best][:, None] - total, -1000, 0)).sum(axis=1)
            known = letters & bool(names)
            pred = [names[b] if ok else UNDETERMINED for b, ok in zip(best, known, strict=True)]
            score = np.where(known, 1 / odds, 0.0)
            bits = np.where(known, total[np.arange(n), best] / np.maximum(np.diff(offsets), 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in keep), pa.array(pred, pa.string()), pa.array(score), pa.array(bits)],
                [*keep, "lang_pred", "score", "bits_per_byte"],
            )


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score and bits_per_byte of every row of ``docs``."""
    counts = count_sample(training_sample(docs, sample))
    frozen = docs.sparkSession.sparkContext.broadcast({lang: tree_of(list(halves.values())) for lang, halves in counts.items()})
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(
        lambda batches: score_languages(frozen.value, batches, ["doc_id", "held_out"]),
        f"doc_id {id_type}, held_out boolean, lang_pred string, score double, bits_per_byte double",
    )


def own_bits(tree: ContextTree, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits for each byte of each text, none of which is empty."""
    wanted, where = np.unique(grams(data, offsets), return_inverse=True)
    return np.add.reduceat(tree.code_lengths(wanted)[where], offsets[:-1]) / np.diff(offsets)


def count_bits(rows: DataFrame, trees: dict[tuple[str, int], ContextTree]) -> dict[str, list[tuple[int, int, int]]]:
    """For each language the (log2 of bytes, step of bits a byte, rows) of texts (lang, half, text) under the tree of language and half."""
    frozen = rows.sparkSession.sparkContext.broadcast(trees)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = frozen.value
        sums: Counter = Counter()
        for batch in batches:
            for lang, half in set(zip(batch.column("lang").to_pylist(), batch.column("half").to_pylist(), strict=True)):
                if (lang, half) not in trees:
                    continue
                mine = batch.filter(pc.and_(pc.equal(batch.column("lang"), lang), pc.equal(batch.column("half"), half)))
                for _, data, offsets in text_chunks(mine, "text", CHUNK_BYTES):
                    steps = np.round(own_bits(trees[lang, half], data, offsets) / STEP).astype(np.int64).tolist()
                    sizes = np.round(np.log2(np.diff(offsets))).astype(np.int64).tolist()
                    sums.update(zip([lang] * len(steps), sizes, steps, strict=True))
        keys = list(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), *(pa.array([k[j] for k in keys], pa.int64()) for j in (1, 2)), pa.array(list(sums.values()), pa.int64())],
            ["lang", "size", "step", "n"],
        )

    counted = rows.mapInArrow(count, "lang string, size long, step long, n long").groupBy("lang", "size", "step").agg(F.sum("n").alias("n"))
    out: dict[str, list[tuple[int, int, int]]] = {}
    for row in counted.collect():
        out.setdefault(row["lang"], []).append((row["size"], row["step"], row["n"]))
    return out


def fit_bounds(docs: DataFrame, sample: DataFrame, counts: Counts) -> dict[str, tuple[float, float]]:
    """For each learned language the median of the bits a byte of its texts, and the spread of one byte."""
    learned = sample.select(F.xxhash64("text").alias("mark")).distinct()
    others = docs.select(F.col("lang").cast("string").alias("lang"), F.lit(0).alias("half"), "text").filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # at most SAMPLE marks a language
    others = others.withColumn("mark", F.xxhash64("text")).join(F.broadcast(learned), "mark", "left_anti").select("lang", "half", "text")
    counted = count_bits(others, {(lang, 0): tree_of(list(halves.values())) for lang, halves in counts.items()})
    few = [lang for lang in counts if sum(n for _, _, n in counted.get(lang, [])) < FEW]
    if few:
        # each half under the tree of the other, or under its own where there is no other
        trees = {(lang, half): tree_of([counts[lang].get(1 - half) or counts[lang][half]]) for lang in few for half in counts[lang]}
        for lang, rows in count_bits(sample.filter("text <> ''"), trees).items():
            counted.setdefault(lang, []).extend(rows)
    out = {}
    for lang in counts:
        if not counted.get(lang):
            out[lang] = (8.0, 0.0)  # only empty texts are labelled so: nothing says what fits
            continue
        size, step, n = np.array(counted[lang], np.int64).T
        middle = _weighted_median(step * STEP, n)
        out[lang] = middle, 1.4826 * _weighted_median(np.abs(step * STEP - middle) * np.exp2(size / 2), n)
    return out


def _weighted_median(x: np.ndarray, n: np.ndarray) -> float:
    order = np.argsort(x)
    sums = np.cumsum(n[order])
    return float(x[order][np.searchsorted(sums, sums[-1] / 2)])


def keep_identified(docs: DataFrame, least_score: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` in a language that was learned; their columns stay as they are."""
    learned = training_sample(docs, sample)
    counts = count_sample(learned)
    trees = {lang: tree_of(list(halves.values())) for lang, halves in counts.items()}
    frozen = docs.sparkSession.sparkContext.broadcast((trees, fit_bounds(docs, learned, counts) if trees else {}))
    columns = docs.columns

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, bounds = frozen.value
        for batch in score_languages(trees, batches, columns):
            # by place, for the names may be taken by columns of docs
            pred, score, bits = (batch.column(len(columns) + k) for k in range(3))
            sure = pc.and_(pc.not_equal(pred, UNDETERMINED), pc.greater_equal(score, least_score))
            middle, spread = np.array([bounds.get(x, (0.0, 0.0)) for x in pred.to_pylist()]).reshape(-1, 2).T
            size = np.maximum(pc.fill_null(pc.binary_length(batch.column(columns.index("text"))), 1).to_numpy(zero_copy_only=False), 1)
            fits = bits.to_numpy() <= middle + LEAST_EXCESS + EXCESS_WIDTH * spread / np.sqrt(size)
            yield batch.filter(pc.and_(sure, pa.array(fits))).select(range(len(columns)))

    return docs.mapInArrow(kept, docs.schema)

"""Quality rules: n-gram perplexity under a modified Kneser-Ney model counted by Spark.

Every text is read as its code points, in lower case and with all white space as one.
Spark counts all n-grams of all texts for each language: a task counts the codes of
its chunks, and the counts are summed by (language, n-gram). An n-gram's hash is its code
points packed, 16 bits each: exact in the basic plane, while points beyond it share the
8448 values that stand for no character there. From the counts a table is made of every n-gram
and its cost under its language's interpolated model, by aggregations and joins: discounts from the counts of
counts of each order, contexts' sums, and the costs of the shorter n-grams. No n-gram is left out, and every
n-gram of every text is in the table, for the texts were counted.

Texts are scored where they lie: the ``HELD`` most frequent n-grams are sent to all tasks as sorted arrays of
hashes and costs. Where a corpus has more, what a task does not find is joined with the table, by n-gram; those are rare,
and no key of that join is a frequent one. Costs are whole numbers, so sums are alike whatever is held.

A text's perplexity is taken under its language's model. The bands come from all
texts: histograms for each language give the median log-perplexity and the spread
of the deviations from it, scaled by the root of the text's length, for a mean over
few symbols strays further. A text is rejected where it lies above or below the
median by more than ``least + width * spread / sqrt(length)``.

Beside the method, ``base_rules`` counts words, symbols, repeated lines and repeated
8-word windows.

Defined results: a null text is empty and fails the base; a null language is a
language of its own; a text without symbols has no perplexity and is judged by
the base alone; rows that repeat an id, or have none, are judged each by itself; an empty table gives an
empty result; only doc_id, text and lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.llm._session import written
from cotejo.llm._text import BYTE_CODES, prefix_hashes, sliding_hashes, span_hashes, text_chunks, word_bounds, word_hashes

ORDER = 4
#: Bits of a packed code point, and how many n-grams (16 bytes each) tasks hold; the others are joined.
POINT_BITS = 16
HELD = 4 << 20
#: Units of a cost: natural logarithms are rounded to whole numbers of them.
UNIT = 1 << 24
#: Languages up to which their discounts are broadcast.
MOST_LANGUAGES = 100_000
#: Spreads (median absolute deviations, made comparable to a standard deviation) and the least half-width of a band.
WIDTH, LEAST_HALF_WIDTH = 4.0, 0.02
#: Steps of log-perplexity and of scaled deviations in the histograms.
STEP, SPREAD_STEP = 0.002, 0.01


def _fold_table() -> np.ndarray:
    table = np.arange(1 << POINT_BITS, dtype=np.uint64)
    for k in range(1 << POINT_BITS):
        low = chr(k).lower()
        if len(low) == 1 and ord(low) < 1 << POINT_BITS:
            table[k] = ord(low)
    table[[0, *range(0x09, 0x0E)]] = 0x20
    return table


FOLD = _fold_table()
#: Values of no character in the basic plane: surrogates and private use.
FREE = np.concatenate([np.arange(0xD800, 0xE000), np.arange(0xE000, 0xF900)]).astype(np.uint64)


def points_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The folded code points of UTF-8 texts, and n+1 offsets of each text's points."""
    first = (data & 0xC0) != 0x80
    at = np.flatnonzero(first)
    places = np.concatenate([[0], np.cumsum(first)])[offsets]
    points = data[at].astype(np.uint32)
    for least, width, mask in ((0xC0, 1, 0x1F), (0xE0, 2, 0x0F), (0xF0, 3, 0x07)):
        k = np.flatnonzero(points >= least) if width == 1 else np.flatnonzero(data[at] >= least)
        value = data[at[k]].astype(np.uint32) & np.uint32(mask)
        for j in range(1, width + 1):
            value = (value << np.uint32(6)) | (data[np.minimum(at[k] + j, len(data) - 1)] & np.uint32(0x3F))
        points[k] = value
    far = points >= 1 << POINT_BITS
    folded = FOLD[np.where(far, 0, points)]
    folded[far] = FREE[points[far] % len(FREE)]
    return folded, places


def codes_of(points: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The n-gram that ends at each point, packed; spaces stand before a text."""
    out = points.copy()
    at = np.arange(len(points)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, order):
        before = np.full(len(points), 0x20, np.uint64)
        before[k:] = points[:-k]
        before[at < k] = 0x20
        out |= before << np.uint64(POINT_BITS * k)
    return out


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, gram and n over all texts; a task adds up its chunks before it sends them."""

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        if len(parts) == 1:
            return parts[0]
        gram, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        return gram, np.bincount(where, weights=np.concatenate([n for _, n in parts]), minlength=len(gram)).astype(np.int64)

    def rows(lang: str | None, parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        gram, n = summed(parts)
        for lo in range(0, len(gram), 50_000):
            own = gram[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own.view(np.int64)), pa.array(n[lo : lo + 50_000])], ["lang", "gram", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        held = 0
        for batch in batches:
            for part, data, byte_offsets in text_chunks(batch, "text"):
                langs = part.column("lang").to_pylist()
                points, offsets = points_of(data, byte_offsets)
                codes = codes_of(points, offsets)
                hash_of = {x: k for k, x in enumerate(dict.fromkeys(langs))}
                each = np.repeat(np.array([hash_of[x] for x in langs], np.int64), np.diff(offsets))
                for lang, k in hash_of.items():
                    gram, n = np.unique(codes[each == k], return_counts=True)
                    sums.setdefault(lang, []).append((gram, n.astype(np.int64)))
                    held += len(gram)
                if held > 1 << 21:
                    sums = {lang: [summed(parts)] for lang, parts in sums.items()}
                    held = sum(len(parts[0][0]) for parts in sums.values())
                if held > 1 << 20:  # after adding up: too many different ones to hold
                    for lang, parts in sums.items():
                        yield from rows(lang, parts)
                    sums, held = {}, 0
        for lang, parts in sums.items():
            yield from rows(lang, parts)

    partial = docs.select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(count, "lang string, gram long, n long")
    return partial.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _few(table: DataFrame) -> DataFrame:
    """A table with a row for each language, marked for broadcast if there are not too many."""
    return F.broadcast(table) if table.limit(MOST_LANGUAGES + 1).count() <= MOST_LANGUAGES else table


def _discounts(grams: DataFrame) -> DataFrame:
    """lang, d1, d2 and d3: what is taken off counts of 1, of 2 and of 3 or more, from the counts of counts."""
    counted = grams.groupBy("lang").agg(*[F.count_if(F.col("c") == j).cast("double").alias(f"n{j}") for j in (1, 2, 3, 4)])
    y = F.col("n1") / F.greatest(F.lit(1.0), F.col("n1") + 2 * F.col("n2"))

    def cut(j: int) -> Column:
        n, more = F.col(f"n{j}"), F.col(f"n{j + 1}")
        return F.when((n > 0) & (more > 0), F.least(F.lit(float(j)), F.greatest(F.lit(0.0), j - (j + 1) * y * more / n))).otherwise(0.5)

    return counted.select("lang", *[cut(j).alias(f"d{j}") for j in (1, 2, 3)])


def model_of(counts: DataFrame) -> DataFrame:
    """lang, gram, n and cost (in units) of every n-gram of ``counts`` (lang, gram, n) under its language's modified Kneser-Ney model."""
    orders = [counts.withColumnRenamed("n", "c")]
    for k in range(ORDER - 1, 0, -1):
        # how many different symbols stand before a shorter n-gram
        shorter = orders[-1].groupBy("lang", F.col("gram").bitwiseAND((1 << POINT_BITS * k) - 1).alias("gram"))
        orders.append(written(shorter.agg(F.count("*").alias("c")), f"quality-order-{k}"))
    below = None
    for k, grams in enumerate(reversed(orders), 1):
        context = F.shiftrightunsigned("gram", POINT_BITS)
        sums = grams.groupBy("lang", context.alias("context")).agg(F.sum("c").alias("total"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2"), F.count_if(F.col("c") > 2).alias("n3"))
        placed = grams.withColumn("context", context).join(sums, ["lang", "context"]).join(_few(_discounts(grams)), "lang")
        if below is None:
            placed = placed.withColumn("shorter", F.lit(2.0**-POINT_BITS))
        else:
            placed = placed.withColumn("end", F.col("gram").bitwiseAND((1 << POINT_BITS * (k - 1)) - 1)).join(below, ["lang", "end"])
        discount = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        back = F.col("n1") * F.col("d1") + F.col("n2") * F.col("d2") + F.col("n3") * F.col("d3")
        p = (F.col("c") - discount + back * F.col("shorter")) / F.col("total")
        below = placed.select("lang", F.col("gram").alias("end"), F.col("c"), p.alias("shorter"))
        below = below if k == ORDER else below.drop("c")
    return below.select("lang", F.col("end").alias("gram"), F.col("c").alias("n"), F.round(-F.log("shorter") * UNIT).cast("long").alias("cost"))


def held_of(model: DataFrame, most: int = HELD) -> tuple[dict[str, tuple[np.ndarray, np.ndarray]], bool]:
    """The most frequent n-grams, ``most`` at most, as sorted hashes and costs for each language; and whether that is all of them."""
    counts = sorted(model.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count("*").alias("grams")).collect(), reverse=True)
    bound, held = (1 << 16) + 1, 0
    for row in counts:
        held += row["grams"]
        if held > most:
            break
        bound = row["n"]
    rows = model.filter(F.least("n", F.lit(1 << 16)) >= bound).select("lang", "gram", "cost").toArrow()
    if not rows.num_rows:
        return {}, held == 0
    langs = rows.column("lang").combine_chunks().dictionary_encode()
    each, gram, cost = langs.indices.to_numpy(), rows.column("gram").to_numpy().view(np.uint64), rows.column("cost").to_numpy()
    out = {}
    for k, lang in enumerate(langs.dictionary.to_pylist()):
        own = np.flatnonzero(each == k)
        own = own[np.argsort(gram[own])]
        out[lang] = gram[own], cost[own]
    return out, held <= most


def repeated_words(hashes: np.ndarray, offsets: np.ndarray, width: int = 8) -> np.ndarray:
    """For each text, its words in ``width``-word windows that occur in it twice or more."""
    n = len(offsets) - 1
    windows = sliding_hashes(hashes, width)
    if not len(windows):
        return np.zeros(n, np.int64)
    start = np.arange(len(windows))
    text = np.repeat(np.arange(n), np.diff(offsets))
    inside = text[: len(windows)] == text[width - 1 :]
    start, key = start[inside], windows[inside]
    order = np.lexsort((key, text[start]))
    key, own = key[order], text[start[order]]
    same = (key[1:] == key[:-1]) & (own[1:] == own[:-1])
    twice = np.zeros(len(key), bool)
    twice[1:] |= same
    twice[:-1] |= same
    found = start[order[twice]]
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, found, 1)
    np.add.at(edge, found + width, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.concatenate([[0], np.cumsum(covered)])[offsets[1:]] - np.concatenate([[0], np.cumsum(covered)])[offsets[:-1]]


def repeated_lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    r"""For each text, its \n-split lines with a word that equal an earlier line of it."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 0x0A)
    text_of_break = np.searchsorted(offsets, breaks, "right") - 1
    begin = np.concatenate([offsets[:-1], breaks + 1])
    end = np.concatenate([offsets[1:], breaks])
    own = np.concatenate([np.arange(n), text_of_break])
    order = np.lexsort((begin, own))
    begin, own = begin[order], own[order]
    # a line ends at the next break of its text, or where the text ends
    end = np.empty(len(begin), np.int64)
    last = np.ones(len(begin), bool)
    last[:-1] = own[1:] != own[:-1]
    end[:-1] = begin[1:] - 1
    end[last] = offsets[own[last] + 1]
    words = np.searchsorted(starts, end) - np.searchsorted(starts, begin)
    begin, end, own = begin[words > 0], end[words > 0], own[words > 0]
    key = span_hashes(prefix_hashes(BYTE_CODES[data]), begin, end)
    order = np.lexsort((key, own))
    key, own = key[order], own[order]
    again = own[1:][(key[1:] == key[:-1]) & (own[1:] == own[:-1])]
    return np.bincount(again, minlength=n)


IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def base_rules(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    starts, ends, words = word_bounds(data, offsets)
    sums = lambda flags: np.concatenate([[0], np.cumsum(flags)])[offsets]
    first_bytes = (data & 0xC0) != 0x80
    separators = np.isin(data, [0x20, *range(0x09, 0x0E)])
    return {
        "n_words": np.diff(words),
        "word_chars": np.diff(sums(first_bytes & ~separators)),
        "n_symbols": np.diff(sums(IS_SYMBOL[data])),
        "n_dup_lines": repeated_lines(data, offsets, starts),
        "n_repeat_words": repeated_words(word_hashes(data, starts, ends), words),
    }


def measure(docs: DataFrame, held: dict[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """doc_id, lang, the base counts, cost (of the n-grams that are held) and rest (gram and n of the others) of every text."""
    frozen = docs.sparkSession.sparkContext.broadcast(held)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    none = np.empty(0, np.uint64), np.empty(0, np.int64)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = frozen.value
        for batch in batches:
            for part, data, offsets in text_chunks(batch, "text"):
                langs = part.column("lang").to_pylist()
                points, places = points_of(data, offsets)
                codes, sizes = codes_of(points, places), np.diff(places)
                cost = np.zeros(len(part), np.int64)
                text = np.repeat(np.arange(len(part)), sizes)
                missing = []
                for lang in dict.fromkeys(langs):
                    mine = np.array([x == lang for x in langs])[text]
                    grams, costs = models.get(lang, none)
                    wanted, where = np.unique(codes[mine], return_inverse=True)
                    at = np.minimum(np.searchsorted(grams, wanted), max(len(grams) - 1, 0))
                    seen = grams[at] == wanted if len(grams) else np.zeros(len(wanted), bool)
                    each = np.where(seen, costs[at] if len(grams) else 0, 0)
                    np.add.at(cost, text[mine], each[where])
                    lost = ~seen[where]
                    missing.append((text[mine][lost], codes[mine][lost]))
                rest = _rest(np.concatenate([t for t, _ in missing]), np.concatenate([g for _, g in missing]), len(part)) if missing else _rest(*none, len(part))
                base = base_rules(data, offsets)
                base["n_points"] = sizes
                columns = [part.column("doc_id"), part.column("lang"), *(pa.array(x.astype(np.int64)) for x in base.values())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cost), rest], ["doc_id", "lang", *base, "cost", "rest"])

    kinds = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_points long, cost long, rest array<struct<gram:long,n:long>>"
    return docs.select("doc_id", "lang", "text").mapInArrow(measured, f"doc_id {id_type}, lang string, {kinds}")


def _rest(text: np.ndarray, gram: np.ndarray, texts: int) -> pa.Array:
    """Of each text its n-grams and how often each is there."""
    text = text.astype(np.int64)
    order = np.lexsort((gram, text))
    text, gram = text[order], gram[order]
    first = np.ones(len(text), bool)
    first[1:] = (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])
    at = np.flatnonzero(first)
    fields = [pa.array(gram[at].view(np.int64)), pa.array(np.diff(np.append(at, len(text))).astype(np.int64))]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text[at], np.arange(texts + 1)), pa.int32()), pa.StructArray.from_arrays(fields, ["gram", "n"]))


def perplexities(docs: DataFrame, most: int = HELD) -> DataFrame:
    """doc_id, lang, the base counts, n_points and log_ppl (null without symbols) of every text of ``docs`` (doc_id, lang, text; lang not null)."""
    model = written(model_of(written(count_grams(docs), "quality-grams")), "quality-model")
    held, whole = held_of(model, most)
    # numbers of rows that are in a table stay as they are
    measured = written(measure(docs, held).withColumn("row", F.monotonically_increasing_id()), "quality-measured")
    per_point = (F.col("cost") / UNIT / F.nullif("n_points", F.lit(0))).alias("log_ppl")
    columns = [c for c in measured.columns if c not in ("cost", "rest", "row")]
    if whole:
        return measured.select(*columns, per_point)
    missing = measured.select("row", "lang", F.inline("rest"))
    more = missing.join(model.select("lang", "gram", F.col("cost").alias("each")), ["lang", "gram"]).groupBy("row").agg(F.sum(F.col("n") * F.col("each")).alias("more"))
    return written(measured.join(more, "row", "left").withColumn("cost", F.col("cost") + F.coalesce("more", F.lit(0))).select(*columns, per_point), "quality-costs")


def _medians(values: DataFrame, step: float) -> dict[str | None, float]:
    """Median of column ``value`` for each language, from a histogram of all rows."""
    steps = values.groupBy("lang", F.round(F.col("value") / step).cast("long").alias("step")).agg(F.count("*").alias("n"))
    by_lang: dict = {}
    for row in steps.filter(F.col("step").isNotNull()).collect():
        by_lang.setdefault(row["lang"], []).append((row["step"] * step, row["n"]))
    return {lang: _weighted_median(*np.array(sorted(rows)).T) for lang, rows in by_lang.items()}


def with_bands(measured: DataFrame, width: float, least: float) -> DataFrame:
    """``measured`` with the log-perplexities ``low`` and ``high`` of each text's band."""
    spark = measured.sparkSession
    middles = _medians(measured.select("lang", F.col("log_ppl").alias("value")), STEP)
    # one row for each language
    centers = F.broadcast(spark.createDataFrame(list(middles.items()), "band_lang string, middle double"))
    centered = measured.join(centers, F.col("lang").eqNullSafe(F.col("band_lang")), "left").drop("band_lang")
    strays = F.abs(F.col("log_ppl") - F.col("middle")) * F.sqrt("n_points")
    spreads = {lang: 1.4826 * x for lang, x in _medians(centered.select("lang", strays.alias("value")), SPREAD_STEP).items()}
    widths = F.broadcast(spark.createDataFrame(list(spreads.items()), "band_lang string, spread double"))
    half = least + width * F.col("spread") / F.sqrt(F.greatest("n_points", F.lit(1)))
    return centered.join(widths, F.col("lang").eqNullSafe(F.col("band_lang")), "left").withColumns({"low": F.col("middle") - half, "high": F.col("middle") + half})


def _weighted_median(x: np.ndarray, n: np.ndarray) -> float:
    order = np.argsort(x)
    sums = np.cumsum(n[order])
    return float(x[order][np.searchsorted(sums, sums[-1] / 2)])


def judge(docs: DataFrame, width: float = WIDTH, least: float = LEAST_HALF_WIDTH, most: int = HELD) -> DataFrame:
    """Base counts, perplexity and verdict of every text of ``docs``; ``most`` n-grams are held by tasks, which changes no result."""
    # a null language is told from all others
    keyed = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("lang"), "text")
    judged = with_bands(perplexities(keyed, most), width, least)
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    within = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(True))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & within).alias("kept"), F.exp("log_ppl").alias("perplexity"),
    )

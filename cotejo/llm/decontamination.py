"""Benchmark decontamination: a broadcast set of normalised benchmark n-grams, and a scan of all documents for them.

Words are runs of digits, letters and non-ASCII characters, with A-Z lower-cased. A *window* is
``WIDTH`` consecutive words of one item; an item of fewer words, but not none, is one window.
Spark cuts the benchmark into pieces of bounded size, whose windows overlap as they should, and
deals them into shards of at most ``SHARD_BYTES`` of words: what is broadcast is a shard, never
the whole of a benchmark of any size. A scan hashes every window of every text, looks it up in
the shard's sorted hash array and compares the words of each hit byte by byte, so a hash
only chooses what is compared. One shard, as any usual benchmark has, is one scan without a
shuffle of texts; of several shards each is a scan, and the hits are joined by the digest of the text.

Defined results: a null or empty text has no words; an item without words has no window; an item
without an id marks words but is not counted; rows that repeat an item id count as one item; rows
of documents that repeat an id, or have none, are judged each by itself; an empty benchmark leaves all clean;
only the named columns of either table are read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.llm._session import written
from cotejo.llm._text import mix, prefix_hashes, span_hashes, strings, text_chunks

#: Words in a window.
WIDTH = 10
#: Bytes of normalised words in a shard at most; this bounds what is broadcast and what the driver holds.
SHARD_BYTES = 8 << 20
#: Words in a piece of an item.
PIECE = 2048

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_CODES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


@dataclass
class Words:
    """The words of some texts: lower-cased, each followed by one space, and where they stood."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text_offsets: np.ndarray
    source_starts: np.ndarray
    source_ends: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    inside = _IS_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    lengths = ends - starts
    to = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths + 1, out=to[1:])
    packed = np.full(to[-1], 0x20, np.uint8)
    is_word = np.ones(to[-1], bool)
    is_word[to[1:] - 1] = False
    packed[is_word] = _LOWER[data[inside]]
    return Words(packed, to[:-1], to[1:] - 1, np.searchsorted(starts, offsets), starts, ends)


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0] .. start[0]+length[0]-1, start[1] .., one after another."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + length, length)


def _same_bytes(a: np.ndarray, a_start: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_end: np.ndarray, at_once: int = 1 << 20) -> np.ndarray:
    """Whether a's k-th span is b's k-th span, byte by byte; ``at_once`` bytes together."""
    out = (a_end - a_start) == (b_end - b_start)
    left = np.flatnonzero(out)
    done = np.cumsum(a_end[left] - a_start[left])
    lo = 0
    while lo < len(left):
        hi = max(int(np.searchsorted(done, (done[lo - 1] if lo else 0) + at_once, "right")), lo + 1)
        k = left[lo:hi]
        length = a_end[k] - a_start[k]
        equal = a[_ranges(a_start[k], length)] == b[_ranges(b_start[k], length)]
        out[k] = np.logical_and.reduceat(equal, np.cumsum(length) - length)
        lo = hi
    return out


def _hashes(words: Words, prefix: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words that begin with word ``first``."""
    return mix(span_hashes(prefix, words.starts[first], words.ends[first + width - 1]) + np.uint64(width))


@dataclass
class WindowSet:
    """Distinct windows, sorted by hash, with their words and the items that hold them.

    ``held`` are positions in ``items``; those of window k lie from ``held_offsets[k]`` on.
    """

    hashes: np.ndarray
    width: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    held_offsets: np.ndarray
    held: np.ndarray
    items: list[str]

    @classmethod
    def of(cls, pieces: pa.Table, width: int) -> WindowSet:
        """From rows (item, words) of ``pieces_of``: a piece shorter than a window is all of its item."""
        data, offsets = strings(pieces.column("words"))
        words = words_of(data, offsets)
        names = pieces.column("item").to_pylist()
        known = {x: k for k, x in enumerate(sorted({x for x in names if x is not None}))}
        holders: dict[bytes, set[int]] = defaultdict(set)
        place: dict[bytes, tuple[int, int]] = {}
        raw = words.data.tobytes()
        for k, name in enumerate(names):
            lo, hi = int(words.text_offsets[k]), int(words.text_offsets[k + 1])
            for first in range(lo, max(hi - width, lo) + 1) if hi > lo else ():
                last = min(first + width, hi) - 1
                gram = raw[words.starts[first] : words.ends[last]]
                place.setdefault(gram, (first, last))
                if name is not None:
                    holders[gram].add(known[name])
        first, last = (np.array([p[k] for p in place.values()], np.int64) for k in (0, 1))
        prefix = prefix_hashes(_CODES[words.data])
        widths = last - first + 1
        hashes = mix(span_hashes(prefix, words.starts[first], words.ends[last]) + widths.astype(np.uint64)) if len(first) else np.empty(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        held = [sorted(holders.get(g, ())) for g in place]
        held = [held[k] for k in order]
        held_offsets = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int64)
        first, last = first[order], last[order]
        return cls(hashes[order], widths[order], words.starts[first], words.ends[last], words.data, held_offsets, np.array([x for y in held for x in y], np.int64), list(known))

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """First word and window of every place in ``words`` where a window stands."""
        prefix = prefix_hashes(_CODES[words.data])
        at, which = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        last_of_text = np.repeat(words.text_offsets[1:], np.diff(words.text_offsets))
        for width in np.unique(self.width):
            first = np.arange(max(len(words.starts) - width + 1, 0))
            first = first[first + width <= last_of_text[: len(first)]]
            if not len(first):
                continue
            asked = _hashes(words, prefix, first, width)
            k = np.searchsorted(self.hashes, asked)
            found = k < len(self.hashes)
            found[found] = self.hashes[k[found]] == asked[found]
            first, k = first[found], k[found]
            while len(first):  # windows of one hash lie side by side; all but one end here at once
                same = self.width[k] == width
                same[same] = _same_bytes(words.data, words.starts[first[same]], words.ends[first[same] + width - 1], self.data, self.starts[k[same]], self.ends[k[same]])
                at.append(first[same])
                which.append(k[same])
                more = ~same & (k + 1 < len(self.hashes))
                more[more] = self.hashes[k[more] + 1] == self.hashes[k[more]]
                first, k = first[more], k[more] + 1
        return np.concatenate(at), np.concatenate(which)

    def items_in(self, text: np.ndarray, which: np.ndarray, texts: int) -> list[list[str]]:
        """For each text the ids of the items that hold one of its windows."""
        pairs = np.unique(np.stack([text, which]), axis=1)
        counts = np.diff(self.held_offsets)[pairs[1]]
        of = np.repeat(pairs[0], counts)
        found = np.unique(np.stack([of, self.held[_ranges(self.held_offsets[pairs[1]], counts)]]), axis=1) if len(of) else np.empty((2, 0), np.int64)
        cuts = np.searchsorted(found[0], np.arange(texts + 1))
        return [[self.items[j] for j in found[1, cuts[k] : cuts[k + 1]]] for k in range(texts)]


def pieces_of(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """item, words, bytes: the items' words in pieces of bounded size. Each window lies in a piece, and none is made up."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_chunks(batch, "text"):
                words, items = words_of(data, offsets), part.column("item").to_pylist()
                raw, rows = words.data.tobytes(), []
                for k, item in enumerate(items):
                    lo, hi = int(words.text_offsets[k]), int(words.text_offsets[k + 1])
                    for first in range(lo, max(hi - width, lo) + 1, PIECE) if hi > lo else ():
                        rows.append((item, raw[words.starts[first] : words.ends[min(first + PIECE + width - 1, hi) - 1]].decode()))
                texts = [r[1] for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array(texts, pa.string()), pa.array([len(x.encode()) for x in texts], pa.int64())], ["item", "words", "bytes"])

    return benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(cut, "item string, words string, bytes long")


def shards_of(benchmark: DataFrame, width: int = WIDTH, shard_bytes: int = SHARD_BYTES) -> Iterator[WindowSet]:
    """The windows of ``benchmark`` in shards of at most ``shard_bytes`` bytes of words (or of one piece)."""
    pieces = written(pieces_of(benchmark, width).dropDuplicates(["item", "words"]), "benchmark-pieces")
    total, longest = pieces.agg(F.sum("bytes"), F.max("bytes")).first()
    shards = max(1, -(-(total or 0) // shard_bytes))
    dealt = lambda n: pieces.withColumn("shard", F.pmod(F.xxhash64("item", "words"), F.lit(n)))
    while shards > 1 and dealt(shards).groupBy("shard").agg(F.sum("bytes").alias("bytes")).agg(F.max("bytes")).first()[0] > max(shard_bytes, longest):
        shards *= 2
    for k in range(shards):
        yield WindowSet.of(dealt(shards).filter(F.col("shard") == k).select("item", "words").toArrow(), width)


def _runs(words: Words, first: np.ndarray, width: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of hit words: text, first word and end, counted within the text."""
    change = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + width, -1)
    hit = np.cumsum(change[:-1]) > 0
    text = np.repeat(np.arange(texts), np.diff(words.text_offsets))
    begins, ends = hit.copy(), hit.copy()
    begins[1:] &= ~(hit[:-1] & (text[1:] == text[:-1]))
    ends[:-1] &= ~(hit[1:] & (text[1:] == text[:-1]))
    lo, hi = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    base = words.text_offsets[text[lo]]
    return text[lo], lo - base, hi - base


def _lists(of: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> pa.Array:
    cuts = pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32())
    spans = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["start", "end"])
    return pa.ListArray.from_arrays(cuts, spans)


def scan(docs: DataFrame, windows: WindowSet) -> DataFrame:
    """The columns of ``docs`` but the text, n_words, spans (maximal runs of hit words, from 0, end exclusive) and items of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(windows)
    kept = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part, data, offsets in text_chunks(batch, "text"):
                n, words = part.num_rows, words_of(data, offsets)
                first, which = known.hits(words)
                items = known.items_in(np.searchsorted(words.text_offsets, first, "right") - 1, which, n)
                spans = _lists(*_runs(words, first, known.width[which], n), n)
                columns = [part.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(words.text_offsets), pa.int64()), spans, pa.array(items, pa.list_(pa.string()))], [*kept, "n_words", "spans", "items"])

    return docs.mapInArrow(scanned, f"{schema}{', ' if kept else ''}n_words long, spans array<struct<start:long,end:long>>, items array<string>")


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_words, spans of hit words (numbered from 0, sorted, apart) and items (ids of those that occur, sorted) of every row.

    Where the benchmark fits one shard, that is one scan. Else each shard is a scan whose
    hits go to a table by the digest of the text, once for equal texts, and the merged hits are joined back.
    """
    shards = shards_of(benchmark, width, shard_bytes)
    first, second = next(shards), next(shards, None)
    texts = docs.select("doc_id", "text")
    if second is None:
        return scan(texts, first)
    keyed = texts.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    found = []
    for k, windows in enumerate(w for some in ([first, second], shards) for w in some):
        hits = scan(keyed.select("digest", "text"), windows).filter(F.size("spans") > 0)
        found.append(written(hits.dropDuplicates(["digest"]).select("digest", "spans", "items"), f"benchmark-hits-{k}"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    merged = every.groupBy("digest").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # runs of several shards may meet or overlap: what begins behind all before it starts a run
    start = F.struct(F.lit(-1).cast("long").alias("start"), F.lit(-1).cast("long").alias("end"))
    apart = F.aggregate(
        "spans",
        F.struct(start.alias("open"), F.expr("cast(array() as array<struct<start:long,end:long>>)").alias("done")),
        lambda a, x: F.when(x["start"] > a["open"]["end"], F.struct(x.alias("open"), F.when(a["open"]["start"] >= 0, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]).alias("done"))).otherwise(
            F.struct(F.struct(a["open"]["start"].alias("start"), F.greatest(a["open"]["end"], x["end"]).alias("end")).alias("open"), a["done"].alias("done"))
        ),
        lambda a: F.concat(a["done"], F.array(a["open"])),
    )
    none = WindowSet.of(pa.table({"item": pa.array([], pa.string()), "words": pa.array([], pa.string())}), width)
    counted = scan(keyed, none).drop("spans", "items")
    joined = counted.join(merged.select("digest", apart.alias("spans"), "items"), "digest", "left")
    empty = lambda kind: F.expr(f"cast(array() as {kind})")
    return joined.select("doc_id", "n_words", F.coalesce("spans", empty("array<struct<start:long,end:long>>")).alias("spans"), F.coalesce("items", empty("array<string>")).alias("items"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated from ``find_contamination``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", width: int = WIDTH, least_share: float = 0.0, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` without what they share with ``benchmark``.

    ``remove="spans"`` cuts each run of hit words, from its first to its last character, out of the text;
    ``remove="documents"`` leaves out the rows of which more than ``least_share`` of the words are hit.
    Both keep all columns, and rows without a hit as they are. Texts pass each shard's scan in turn; documents are dropped
    by the words that all shards together hit.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove is spans or documents, not {remove!r}")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    spans: list[str] = []
    for k, windows in enumerate(shards_of(benchmark, width, shard_bytes)):
        spans.append(f"spans{k}")
        again = rows.withColumn("kept_text", F.col("text"))
        rows = scan(again, windows).withColumnsRenamed({"kept_text": "text", "spans": spans[-1]}).drop("items", "n_words")
    schema = docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_chunks(batch, "text"):
                words = words_of(data, offsets)
                found = [part.column(c).to_pylist() for c in spans]
                texts, share = part.column("text").to_pylist(), []
                for k, every in enumerate(zip(*found, strict=True)):
                    base, n = int(words.text_offsets[k]), int(words.text_offsets[k + 1] - words.text_offsets[k])
                    hit = np.zeros(n, bool)
                    for x in (x for some in every for x in some):
                        hit[x["start"] : x["end"]] = True
                    share.append(hit.sum() / n if n else 0.0)
                    if remove == "spans" and hit.any():
                        edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
                        raw, out, at = texts[k].encode(), [], 0
                        for lo, hi in zip(edges[::2], edges[1::2], strict=True):
                            out.append(raw[at : words.source_starts[base + lo] - offsets[k]])
                            at = words.source_ends[base + hi - 1] - offsets[k]
                        texts[k] = b"".join([*out, raw[at:]]).decode()
                stays = pa.array([remove == "spans" or x == 0 or x <= least_share for x in share], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string())], ["row", "new_text"]).filter(stays)

    done = rows.mapInArrow(cut, f"row {docs.select(F.struct(*[F.col(f'`{c}`') for c in docs.columns]).alias('row')).schema['row'].dataType.simpleString()}, new_text string")
    return done.select(*[(F.col("new_text") if f.name == "text" else F.col("row").getField(f.name)).alias(f.name) for f in schema])


ORACLE = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
grams AS (SELECT DISTINCT item_id, array_to_string(w[p : p + 9], ' ') AS g, least(len(w), 10) AS width
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM items WHERE len(w) > 0)),
widths AS (SELECT DISTINCT width FROM grams),
places AS (SELECT doc_id, p, width, array_to_string(w[p : p + width - 1], ' ') AS g
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS p FROM words, widths)),
found AS (SELECT DISTINCT doc_id, p, width, g FROM places SEMI JOIN grams USING (g, width)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + width)) AS q FROM found) GROUP BY doc_id),
held AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found JOIN grams USING (g, width) WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(held.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN held USING (doc_id)
"""

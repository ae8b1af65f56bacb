"""Which windows of a document also start in a document with a smaller id, by Spark jobs.

1. Documents are packed into *blocks* of bounded size, one row each, in a table that is
   bucketed by block: answers come to the blocks, and texts are not shuffled at all.
2. Each block is parsed into phrases (see ``_anchors``) and sends two short keys for each,
   sorted and packed, to the keys' shards. A shard answers which keys two documents hold. Phrases
   without such a key share no window with another document and go no further.
3. Each block sends the units of its distinct other phrases, once each, to the shard of their
   trigger. All occurrences of a window meet there, and the operator's own method locates what
   smaller documents hold (``locate``).
4. Blocks are joined with these answers and finished.

What meets in a shard is one item for each block and distinct phrase, however many documents
of the block hold it. Keys only choose what is sent, with more at worst if they collide;
what is removed was compared unit by unit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.llm._anchors import phrases, side_keys
from cotejo.llm._session import bucketed, partitions, written
from cotejo.llm._text import U64, row_ranges, strings

#: Bytes of text in a block, unless one text alone is longer, and bytes parsed at once.
BLOCK_BYTES, PARSE_BYTES = 4 << 20, 256 << 10
#: Shards for each shuffle partition at least, and the bytes of text behind one at most.
SHARDS, SHARD_BYTES = 2, 64 << 20
CODEC = pa.Codec("zstd", compression_level=3)


def squeeze(*parts: np.ndarray | bytes) -> bytes:
    raw = b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts)
    return len(raw).to_bytes(8, "little") + CODEC.compress(raw, asbytes=True)


def expand(packed: bytes) -> bytes:
    return CODEC.decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True)


def columns_of(raw: bytes, n: int, kinds: tuple[str, ...]) -> tuple[list[np.ndarray], int]:
    """``n`` values of each kind, one after the other, and where they end."""
    out, at = [], 0
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out, at


@dataclass
class Units:
    """How a text is read: as what it is packed, and what its units are.

    ``normal`` gives the bytes and offsets to keep. ``read`` gives hashes of the units, the
    offsets of each text's units, and each unit's first byte and the byte behind it.
    """

    normal: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    read: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    length: int
    width: int


@dataclass
class Shard:
    """Phrases of one shard, each once for every block that holds it.

    ``data`` and ``offsets`` are their bytes, ``ahead`` says how many units their trigger lies
    behind their start, ``least`` is the smallest document of the block that holds it, and
    ``several`` tells whether the block has more than one that does.
    """

    data: np.ndarray
    offsets: np.ndarray
    ahead: np.ndarray
    least: np.ndarray
    several: np.ndarray


#: What a smaller document holds: item of the shard, first and last byte in it, and that document.
Located = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
Locate = Callable[[Shard], Located]
#: Packed bytes, their offsets and which of them are to go -> columns.
Finish = Callable[[np.ndarray, np.ndarray, np.ndarray], list[pa.Array]]


def distinct(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte string the number of the distinct string it is, and the first place of each; compared byte by byte."""
    column = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    code = column.dictionary_encode().indices.to_numpy().astype(np.int64)
    first = np.full(int(code.max(initial=-1)) + 1, len(code), np.int64)
    np.minimum.at(first, code, np.arange(len(code)))
    return code, first


def gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of stretches of ``data`` one after the other, and their n+1 offsets."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    return data[np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)], offsets


def covered(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n units lie in one of the stretches [begin, end)."""
    edge = np.bincount(begin, minlength=n + 1).astype(np.int64)
    edge -= np.bincount(end, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def packed_blocks(docs: DataFrame, units: Units) -> DataFrame:
    """block, n, text, meta: all documents, with offsets, ids and whether there is an id in meta."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            data = np.concatenate([w[0] for w in waiting])
            sizes = np.concatenate([w[1] for w in waiting])
            ids, known = np.concatenate([w[2] for w in waiting]), np.concatenate([w[3] for w in waiting])
            columns = [pa.array([len(ids)]), pa.array([squeeze(data)], pa.binary()), pa.array([squeeze(sizes, ids, known)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["n", "text", "meta"])

        for batch in batches:
            data, offsets = strings(batch.column("text"))
            ids = batch.column("doc_id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            for lo, hi in row_ranges(offsets, BLOCK_BYTES):
                held, at = units.normal(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                if waiting and size + len(held) > BLOCK_BYTES:
                    yield flush()
                    waiting, size = [], 0
                waiting.append((held, np.diff(at), ids[lo:hi], known[lo:hi]))
                size += len(held)
        if waiting:
            yield flush()

    blocks = rows.mapInArrow(packed, "n long, text binary, meta binary")
    return blocks.select(F.monotonically_increasing_id().alias("block"), "n", "text", "meta")


def shards_for(blocks: int, partitions: int) -> int:
    """How many shards the blocks' keys and phrases are dealt into: what meets in one does not grow with the corpus."""
    return max(SHARDS * partitions, -(-blocks * BLOCK_BYTES // SHARD_BYTES))


class Block:
    """One row of the block table and its parse."""

    def __init__(self, n: int, text: bytes, meta: bytes, units: Units, shards: int):
        (sizes, self.ids, self.known), _ = columns_of(expand(meta), n, ("i8", "i8", "?"))
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.data = np.frombuffer(expand(text), np.uint8)
        found = []
        for lo, hi in row_ranges(self.offsets, PARSE_BYTES):
            base = self.offsets[lo]
            codes, edges, first, behind = units.read(self.data[base : self.offsets[hi]], self.offsets[lo : hi + 1] - base)
            p = phrases(codes, edges, units.length, units.width)
            end = p.start + p.windows - 1 + units.length
            left, right = side_keys(codes, p.start, end, p.ahead, units.length, units.width)
            found.append((lo + p.text, base + first[p.start], base + behind[end - 1], p.ahead, p.trigger, left, right) if len(p.text) else [np.empty(0, k) for k in ("i8", "i8", "i8", "i8", "u8", "u8", "u8")])
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0, k) for k in ("i8", "i8", "i8", "i8", "u8", "u8", "u8")]
        mine = self.known[columns[0]]
        doc, self.start, self.end, self.ahead, self.trigger, left, right = (c[mine] for c in columns)
        self.doc = self.ids[doc]
        # all keys of the block, each once, by shard
        self.has = np.stack([left != 0, right != 0])
        keys = np.stack([left, right])[self.has]
        by_shard = (keys % U64(shards)) << U64(32) | keys >> U64(32)
        self.keys, self.of = np.unique(by_shard, return_inverse=True)
        self.shards = shards

    def key_docs(self) -> np.ndarray:
        """For each key, whether several documents of the block hold it."""
        doc = np.broadcast_to(self.doc, self.has.shape)[self.has]
        low, high = np.full(len(self.keys), np.iinfo(np.int64).max), np.full(len(self.keys), np.iinfo(np.int64).min)
        np.minimum.at(low, self.of, doc)
        np.maximum.at(high, self.of, doc)
        return low < high

    def shard_edges(self, shard: np.ndarray) -> np.ndarray:
        return np.searchsorted(shard, np.arange(self.shards + 1))

    def shared(self, answers: list[dict] | None) -> None:
        """Keeps the phrases with a key that two documents hold, and numbers the distinct ones, by shard."""
        edges = self.shard_edges((self.keys >> U64(32)).astype(np.int64))
        live = np.zeros(len(self.keys), bool)
        for a in answers or ():
            lo, hi = edges[a["shard"]], edges[a["shard"] + 1]
            live[lo:hi] = np.unpackbits(np.frombuffer(expand(a["packed"]), np.uint8), count=hi - lo).astype(bool)
        held = np.zeros(self.has.shape, bool)
        held[self.has] = live[self.of]
        kept = held.any(axis=0)
        self.doc, self.start, self.end, self.ahead, self.trigger = (c[kept] for c in (self.doc, self.start, self.end, self.ahead, self.trigger))
        code, first = distinct(*gathered(self.data, self.start, self.end))
        shard = (self.trigger[first] % U64(self.shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        self.item, self.first = number[code], first[order]
        self.item_edges = self.shard_edges(shard[order])


def _rows(found: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)] if found else [pa.array([], k) for k in kinds], names)


_SENT = "block long, shard int, n int, packed binary"
_SENT_NAMES, _SENT_KINDS = ["block", "shard", "n", "packed"], [pa.int64(), pa.int32(), pa.int32(), pa.binary()]


def _answered(sent: DataFrame, answer: Callable[[list[tuple[int, bytes]]], list[bytes | None]]) -> DataFrame:
    """block, answers: what each shard says to the rows that blocks sent to it, as (shard, packed)."""

    def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def said() -> pa.RecordBatch:
            told = answer([(n, packed) for _, n, packed in waiting])
            return _rows([(b, current, t) for (b, _, _), t in zip(waiting, told, strict=True) if t is not None], ["block", "shard", "packed"], [pa.int64(), pa.int32(), pa.binary()])

        waiting, current = [], None
        for batch in batches:
            for block, shard, n, packed in zip(*(batch.column(c).to_pylist() for c in _SENT_NAMES), strict=True):
                if shard != current and waiting:
                    yield said()
                    waiting = []
                current = shard
                waiting.append((block, n, packed))
        if waiting:
            yield said()

    dealt = sent.repartition(partitions(sent.sparkSession), "shard").sortWithinPartitions("shard")
    answers = dealt.mapInArrow(by_shard, "block long, shard int, packed binary")
    return answers.groupBy("block").agg(F.collect_list(F.struct("shard", "packed")).alias("answers"))


def _shared_keys(rows: list[tuple[int, bytes]]) -> list[bytes | None]:
    """For each block, which of its keys two documents hold, as bits."""
    keys, several = [], []
    for n, packed in rows:
        raw = np.frombuffer(expand(packed), np.uint8)
        steps = np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view(np.uint32).ravel()
        keys.append(np.cumsum(steps, dtype=np.uint64).astype(np.uint32))
        several.append(np.unpackbits(raw[4 * n :], count=n).astype(bool))
    all_keys = np.concatenate(keys)
    order = np.argsort(all_keys)
    held = all_keys[order]
    twice = np.zeros(len(held), bool)
    twice[1:] = held[1:] == held[:-1]
    twice[:-1] |= twice[1:].copy()
    live = np.empty(len(held), bool)
    live[order] = twice
    live |= np.concatenate(several)
    edges = np.concatenate([[0], np.cumsum([n for n, _ in rows])])
    return [squeeze(np.packbits(live[a:b])) if live[a:b].any() else None for a, b in zip(edges[:-1], edges[1:], strict=True)]


_ITEM, _FOUND = ("u4", "u1", "?", "i8"), ("u4", "u4", "u4", "i8")


def _located(rows: list[tuple[int, bytes]], locate: Locate) -> list[bytes | None]:
    parts, data = [], []
    for n, packed in rows:
        raw = expand(packed)
        columns, at = columns_of(raw, n, _ITEM)
        parts.append(columns)
        data.append(np.frombuffer(raw, np.uint8, offset=at))
    size, ahead, several, step = (np.concatenate(x) for x in zip(*parts, strict=True))
    least = np.concatenate([np.cumsum(p[3]) for p in parts])
    offsets = np.concatenate([[0], np.cumsum(size.astype(np.int64))])
    item, start, end, holder = locate(Shard(np.concatenate(data), offsets, ahead.astype(np.int64), least, several))
    order = np.argsort(item, kind="stable")
    item, start, end, holder = item[order], start[order], end[order], holder[order]
    edges = np.concatenate([[0], np.cumsum([n for n, _ in rows])])
    cuts = np.searchsorted(item, edges)
    return [
        squeeze((item[a:b] - base).astype("u4"), start[a:b].astype("u4"), end[a:b].astype("u4"), holder[a:b].astype("i8")) if a < b else None
        for a, b, base in zip(cuts[:-1].tolist(), cuts[1:].tolist(), edges[:-1].tolist(), strict=True)
    ]


def dedup(docs: DataFrame, units: Units, locate: Locate, finish: Finish, result: str, names: list[str]) -> DataFrame:
    """doc_id and the columns ``result`` that ``finish`` makes of every row of ``docs``.

    ``finish`` gets the packed bytes of a block, their offsets and which bytes are to go.
    Rows with a null doc_id neither hold nor lose anything; rows with the same id
    do not take from each other.
    """
    blocks = bucketed(packed_blocks(docs, units), "repeats-blocks", "block")
    shards = shards_for(blocks.count(), partitions(docs.sparkSession))

    def read(batch: pa.RecordBatch) -> Iterator[tuple[int, Block, dict]]:
        for row in batch.to_pylist():
            yield row["block"], Block(row["n"], row["text"], row["meta"], units, shards), row

    def send_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, block, _ in read(batch):
                several = block.key_docs()
                edges = block.shard_edges((block.keys >> U64(32)).astype(np.int64))
                found = []
                for s, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                    if lo < hi:
                        steps = np.diff(block.keys[lo:hi].astype(np.uint32), prepend=np.uint32(0))
                        planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T)
                        found.append((number, s, hi - lo, squeeze(planes, np.packbits(several[lo:hi]))))
                yield _rows(found, _SENT_NAMES, _SENT_KINDS)

    told = written(_answered(blocks.mapInArrow(send_keys, _SENT), _shared_keys), "repeats-shared")
    known = blocks.join(told, "block", "left")

    def send_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, block, row in read(batch):
                block.shared(row["answers"])
                n = len(block.first)
                least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
                np.minimum.at(least, block.item, block.doc)
                np.maximum.at(most, block.item, block.doc)
                found = []
                for s, (lo, hi) in enumerate(zip(block.item_edges[:-1].tolist(), block.item_edges[1:].tolist(), strict=True)):
                    if lo < hi:
                        at = block.first[lo:hi]
                        data, offsets = gathered(block.data, block.start[at], block.end[at])
                        columns = (np.diff(offsets), block.ahead[at], least[lo:hi] < most[lo:hi], np.diff(least[lo:hi], prepend=0))
                        found.append((number, s, hi - lo, squeeze(*(c.astype(k) for c, k in zip(columns, _ITEM, strict=True)), data)))
                yield _rows(found, _SENT_NAMES, _SENT_KINDS)

    located = _answered(known.filter("answers is not null").mapInArrow(send_phrases, _SENT), lambda rows: _located(rows, locate))
    both = known.join(located.withColumnRenamed("answers", "located"), "block", "left")

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["located"]:
                    block = Block(row["n"], row["text"], row["meta"], units, shards)
                    gone = _removed(block, row["answers"], row["located"])
                    ids, known, data, offsets = block.ids, block.known, block.data, block.offsets
                else:
                    (sizes, ids, known), _ = columns_of(expand(row["meta"]), row["n"], ("i8", "i8", "?"))
                    data, offsets = np.frombuffer(expand(row["text"]), np.uint8), np.concatenate([[0], np.cumsum(sizes)])
                    gone = np.zeros(len(data), bool)
                for lo, hi in row_ranges(offsets, PARSE_BYTES):
                    at = offsets[lo : hi + 1]
                    done = finish(data[at[0] : at[-1]], at - at[0], gone[at[0] : at[-1]])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi], mask=~known[lo:hi]), *done], ["doc_id", *names])

    return both.mapInArrow(complete, f"doc_id long, {result}")


def _removed(block: Block, answers: list[dict], located: list[dict]) -> np.ndarray:
    """The bytes of a block that smaller documents hold, from what was located in its distinct phrases."""
    block.shared(answers)
    parts = []
    for told in located:
        raw = expand(told["packed"])
        (item, start, end, holder), _ = columns_of(raw, len(raw) // 20, _FOUND)
        parts.append((block.item_edges[told["shard"]] + item.astype(np.int64), start.astype(np.int64), end.astype(np.int64), holder))
    item, start, end, holder = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(block.item, kind="stable")
    edges = np.searchsorted(block.item[order], np.arange(len(block.first) + 1))
    n = edges[item + 1] - edges[item]
    which = np.repeat(np.arange(len(item)), n)
    at = order[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + edges[item][which]]
    lost = block.doc[at] > holder[which]
    at, which = at[lost], which[lost]
    return covered(len(block.data), block.start[at] + start[which], block.start[at] + end[which])

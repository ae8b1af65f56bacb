"""Exact substring removal at byte level by prefix-free parsing.

A rolling hash picks triggers, which cut the corpus into phrases (see ``_anchors``). The distinct
phrases are the dictionary, each known by the smallest document that holds it; the parse says
which document holds which of them. Phrases overlap so far that the first 50 bytes of any
suffix of the corpus, from the phrase in which they start, lie in that one phrase. So the sorted suffixes of the
dictionary, read with the parse's holders, tell which 50-byte strings of the corpus are equal. That is all the result
needs, and all that is built: the parse's own suffix array, which would order what agrees in 50 bytes already, is
not, nor is a full order of the corpus's suffixes, and dictionary suffixes are sorted within shards.

The dictionary is dealt into shards by trigger, where each shard sorts the suffixes of its distinct phrases by
their bytes; neighbours that share 50 bytes are one string, held by the smallest document of all its phrases.
Phrases that agree with no other phrase on either side of their trigger share no
string with one, and their suffixes need no sorting (see ``_anchors.side_keys``).
How phrases get to shards and answers back to documents: see ``_repeats``.

Defined results: a null text is empty; texts below 50 bytes lose nothing; a null
doc_id neither takes nor loses; rows that repeat an id do not take from each other;
an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cotejo.llm._anchors import side_keys
from cotejo.llm._repeats import Located, Shard, Units, dedup, distinct, gathered
from cotejo.llm._text import BYTE_CODES

LENGTH, TRIGGER = 50, 16


def suffix_order(data: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """``at`` in the order of the ``depth`` bytes that stand there, and which of them differ from the one before."""
    eight = np.ndarray(len(data) - 7, ">u8", data, strides=(1,))
    keys = [eight[at + k].astype(np.uint64) for k in (*range(0, depth - 8, 8), depth - 8)]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(at), bool)
    new[:1] = True
    for key in keys:
        sorted_ = key[order]
        new[1:] |= sorted_[1:] != sorted_[:-1]
    return order, new


def _shared(keys: np.ndarray) -> np.ndarray:
    """Which keys, 0 aside, come up more than once."""
    _, of, n = np.unique(keys, return_inverse=True, return_counts=True)
    return (n[of] > 1) & (keys != 0)


def held_strings(length: int, width: int):
    """Locates in each phrase of a shard the strings that smaller documents hold."""

    def locate(shard: Shard) -> Located:
        code, first = distinct(shard.data, shard.offsets)
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, code, shard.least)
        # the parse: whatever document holds an entry after its smallest one loses all of it
        whole = np.flatnonzero((shard.least > least[code]) | shard.several)
        found = [(whole, np.zeros(len(whole), np.int64), np.diff(shard.offsets)[whole], least[code[whole]])]
        # the dictionary: the strings of its entries in order
        data, offsets = gathered(shard.data, shard.offsets[first], shard.offsets[first + 1])
        ahead, count = shard.ahead[first], np.diff(offsets) - length + 1
        keys = side_keys(BYTE_CODES[data], offsets[:-1], offsets[1:], ahead, length, width)
        left, right = (_shared(k) for k in keys)
        open_ = np.flatnonzero(left | right)
        entry = np.repeat(open_, count[open_])
        start = np.arange(len(entry)) - np.repeat(np.cumsum(count[open_]) - count[open_], count[open_])
        side = (length - width + 1) // 2
        before = ahead[entry] - start
        fit = left[entry] & (before >= side) | right[entry] & (length - width - before >= side)
        entry, start = entry[fit], start[fit]
        if len(entry):
            order, new = suffix_order(data, offsets[entry] + start, length)
            run = np.cumsum(new) - 1
            holder = np.empty(len(order), np.int64)
            holder[order] = np.minimum.reduceat(least[entry[order]], np.flatnonzero(new))[run]
            taken = holder < least[entry]
            entry, start, holder = entry[taken], start[taken], holder[taken]
        if len(entry):
            # neighbouring strings with one holder are one stretch
            new = np.ones(len(entry), bool)
            new[1:] = (entry[1:] != entry[:-1]) | (start[1:] != start[:-1] + 1) | (holder[1:] != holder[:-1])
            begin = np.flatnonzero(new)
            last = np.append(begin, len(entry))[1:] - 1
            stretch = entry[begin], start[begin], start[last] + length, holder[begin]
            # for the entry's smallest document; the others lose all of it anyway
            mine = np.flatnonzero(shard.least == least[code])
            lo, hi = np.searchsorted(stretch[0], code[mine]), np.searchsorted(stretch[0], code[mine], "right")
            n = hi - lo
            which = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            found.append((np.repeat(mine, n), *(s[which] for s in stretch[1:])))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    return locate


def byte_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    at = np.arange(len(data) + 1)
    return BYTE_CODES[data], offsets, at[:-1], at[1:]


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes of every document."""

    def finish(data: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> list[pa.Array]:
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = offsets[:-1][offsets[:-1] < len(data)]
        begins[inner] = gone[inner]
        count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
        left = offsets - np.concatenate([[0], np.cumsum(gone)])[offsets]
        raw = data[~gone].tobytes()
        kept = [raw[a:b] for a, b in zip(left[:-1].tolist(), left[1:].tolist(), strict=True)]
        sums = [hashlib.sha256(x).hexdigest() for x in kept]
        out = [pa.array(np.diff(offsets)), pa.array(count(gone)), pa.array(count(begins)), pa.array(sums, pa.string())]
        return [*out, pa.array(kept, pa.binary())] if keep_bytes else out

    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_bytes]
    result = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes
    units = Units(lambda data, offsets: (data, offsets), byte_units, length, TRIGGER)
    return dedup(docs, units, held_strings(length, TRIGGER), finish, result, names)

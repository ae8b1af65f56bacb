"""Hashed counts of character n-grams of many texts at once: the features of Spark's ``HashingTF``, without a string for each place of a text."""

from __future__ import annotations

import numpy as np


def murmur3(term: bytes, seed: int = 42) -> int:
    """The unsigned 32-bit hash that ``HashingTF`` takes of a term's UTF-8 bytes."""
    mask, h = 0xFFFFFFFF, seed
    turn = lambda x, by: (x << by | x >> 32 - by) & mask
    mixed = lambda k: turn(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    whole = len(term) // 4 * 4
    for i in range(0, whole, 4):
        h = (turn(h ^ mixed(int.from_bytes(term[i : i + 4], "little")), 13) * 5 + 0xE6546B64) & mask
    if term[whole:]:
        h ^= mixed(int.from_bytes(term[whole:], "little"))
    h ^= len(term)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    return h ^ h >> 16


def bucket(term: str, features: int) -> int:
    h = murmur3(term.encode("utf-8", "replace"))
    return (h - (1 << 32) if h >> 31 else h) % features


def gram_counts(texts: list[str], n: int, features: int, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, bucket (ascending in each text) and count of the runs of ``n`` characters of ``texts``; ``known`` holds the buckets of runs seen before."""
    units = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    if len(units) < n:
        return (np.empty(0, np.int64),) * 3
    letters, code = np.unique(units, return_inverse=True)
    whole = np.flatnonzero(text[: len(text) - n + 1] == text[n - 1 :])
    grams = np.zeros(len(whole), np.int64)
    size = 1
    for j in range(n):
        if size * len(letters) >= 1 << 62:  # numbers of runs are made dense before they outgrow 64 bits
            distinct, grams = np.unique(grams, return_inverse=True)
            size = len(distinct)
        grams, size = grams * len(letters) + code[whole + j], size * len(letters)
    _, first, grams = np.unique(grams, return_index=True, return_inverse=True)
    buckets = np.empty(len(first), np.int64)
    for i, at in enumerate(whole[first].tolist()):
        term = units[at : at + n].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
        if (own := known.get(term)) is None:
            own = known[term] = bucket(term, features)
        buckets[i] = own
    pairs, count = np.unique(text[whole] * features + buckets[grams], return_counts=True)
    return pairs // features, pairs % features, count

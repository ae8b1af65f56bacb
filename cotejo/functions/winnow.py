"""Winnowed fingerprints of many texts at once: MD5 of every run of k characters, and the least of each window, on whole arrays."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of texts, texts, and runs of characters, that are worked on at once.
BYTES, TEXTS, RUNS = 1 << 20, 1 << 15, 1 << 15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FIRST = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
#: Of each of MD5's steps: which word, what is added, and by how much bits turn to the left, as two shifts.
_STEPS = [
    ((i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16, np.uint32(int(abs(math.sin(i + 1)) * 2**32)), np.uint32(_TURNS[i // 16][i % 4]), np.uint32(32 - _TURNS[i // 16][i % 4]))
    for i in range(64)
]
#: Of a word of which 0 to 4 bytes are the run's (at 1 to 5; at 0 the run ended before it): those bytes, and the mark behind them.
_MASK = np.array([0, 0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
_MARK = np.array([0, 0x80, 0x8000, 0x800000, 0x80000000, 0], np.uint32)


def _words(fours: np.ndarray, start: np.ndarray, length: np.ndarray) -> list[np.ndarray | None]:
    """The 16 words of the one block that MD5 makes of each run of 55 bytes or fewer, None for zeros; ``fours`` holds the word that begins at each byte."""
    most, least = int(length.max()), int(length.min())
    out: list[np.ndarray | None] = [None] * 16
    for j in range(most // 4 + 1):
        word = fours.take(start + 4 * j)
        if 4 * j + 4 > least:
            own = np.clip(length - 4 * j, -1, 4) + 1  # how many of its bytes are the run's, from 1; 0 behind the end mark
            word &= _MASK[own]
            word |= _MARK[own]
        out[j] = word
    out[14] = (8 * length).astype(np.uint32)
    return out


def _md5(words: list[np.ndarray | None], n: int) -> np.ndarray:
    """The first 48 bits of the digests."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _FIRST)
    f, low = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i, (word, sine, up, down) in enumerate(_STEPS):
        if i < 16:
            np.bitwise_xor(c, d, f)
            np.bitwise_and(f, b, f)
            np.bitwise_xor(f, d, f)
        elif i < 32:
            np.bitwise_xor(b, c, f)
            np.bitwise_and(f, d, f)
            np.bitwise_xor(f, c, f)
        elif i < 48:
            np.bitwise_xor(b, c, f)
            np.bitwise_xor(f, d, f)
        else:
            np.invert(d, f)
            np.bitwise_or(f, b, f)
            np.bitwise_xor(f, c, f)
        np.add(a, f, a)
        np.add(a, sine, a)
        if words[word] is not None:
            np.add(a, words[word], a)
        np.right_shift(a, down, low)
        np.left_shift(a, up, a)
        np.bitwise_or(a, low, a)
        np.add(a, b, a)
        a, d, c, b = d, c, b, a
    a += np.uint32(_FIRST[0])
    b += np.uint32(_FIRST[1])
    return a.byteswap().astype(np.int64) << 16 | (b.byteswap() >> np.uint32(16)).astype(np.int64)


def md5_48(text: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The first 48 bits of the MD5 of each run of bytes, as a number."""
    out = np.empty(len(start), np.int64)
    fours = np.zeros(len(text) + 64, np.uint32)
    for i in range(4):
        fours[: max(0, len(text) - i)] |= text[i:].astype(np.uint32) << np.uint32(8 * i)
    for lo in range(0, len(start), RUNS):
        at, size = start[lo : lo + RUNS], length[lo : lo + RUNS]
        if size.max() <= 55:
            out[lo : lo + RUNS] = _md5(_words(fours, at, size), len(at))
        else:
            out[lo : lo + RUNS] = [int.from_bytes(hashlib.md5(text[s : s + n].tobytes()).digest()[:6]) for s, n in zip(at.tolist(), size.tolist(), strict=True)]
    return out


def _least_of_windows(values: np.ndarray, window: int) -> np.ndarray:
    """The least of each run of ``window`` neighbours."""
    done = 1
    while done < window:
        step = min(done, window - done)
        values, done = np.minimum(values[:-step], values[step:]), done + step
    return values


def _of_bytes(data: np.ndarray, ends: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """text and fingerprint, each pair once, of texts that lie one behind the other and end at ``ends``."""
    blank = _SPACE[data]
    ends = ends - np.concatenate([[0], np.cumsum(blank)])[ends]
    data = data[~blank]
    first = np.flatnonzero((data & 0xC0) != 0x80)  # of each character
    last = np.searchsorted(first, ends)  # characters before a text's end
    count = np.diff(last, prepend=0)
    text = np.repeat(np.arange(len(ends)), count)
    if len(first) < k:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # where a run of k begins that stays in its text
    whole = np.flatnonzero(text[: len(text) - k + 1] == text[k - 1 :])
    bounds = np.append(first, len(data))
    start = first[whole]
    text, hashes = text[whole], md5_48(data, start, bounds[whole + k] - start)
    own = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(hashes) >= window:
        inside = text[: len(text) - window + 1] == text[window - 1 :]
        own = text[: len(inside)][inside], _least_of_windows(hashes, window)[inside]
    runs = np.bincount(text, minlength=len(ends))
    few = (runs < window)[text]
    if few.any():  # texts with fewer than a window: their least one
        least = np.full(len(ends), np.iinfo(np.int64).max)
        np.minimum.at(least, text[few], hashes[few])
        short = np.flatnonzero((runs > 0) & (runs < window))
        own = np.concatenate([own[0], short]), np.concatenate([own[1], least[short]])
    # a text's place and 48 bits make one number, which sorts fast
    pairs = np.sort(own[0] << 48 | own[1])
    pairs = pairs[np.flatnonzero(np.diff(pairs, prepend=-1))]
    return pairs >> 48, pairs & (1 << 48) - 1


def fingerprints(texts: pa.Array, k: int, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of texts in a column of strings, and their fingerprints, for a part of the texts at a time; a null text has none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    sizes = texts.cast(pa.large_binary())
    offsets = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1]
    data = np.frombuffer(sizes.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(sizes):
        hi = min(max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BYTES, "right")) - 1), lo + TEXTS)
        of, chosen = _of_bytes(data[offsets[lo] : offsets[hi]], offsets[lo + 1 : hi + 1] - offsets[lo], k, window)
        yield lo + of, chosen
        lo = hi

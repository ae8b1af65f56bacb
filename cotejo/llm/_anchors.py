"""Prefix-free parsing: phrases around triggers that a rolling hash chooses.

Of the ``width``-unit grams in a run of ``length`` units (a window) the one whose rolling
hash is least, and of equals the first, is a *trigger*. So no window is without one,
and equal windows choose alike wherever they stand. The windows of one trigger stand
side by side; what they cover together is a *phrase*, which overlaps the next one by all
but one unit of a window. Each window lies in exactly one phrase, at the same distance from
the trigger wherever it occurs, and never runs on into the next.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from cotejo.llm._text import U64, mix, prefix_hashes, sliding_hashes, span_hashes

U32 = U64(32)
LOW = U64(0xFFFFFFFF)


@dataclass
class Phrases:
    """One row for each trigger, in order.

    Its text, the unit at which its first window starts, how many windows it has, how far
    its trigger lies behind that start, and the trigger's hash.
    """

    text: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    ahead: np.ndarray
    trigger: np.ndarray


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    rest = width - span
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


def phrases(units: np.ndarray, offsets: np.ndarray, length: int, width: int) -> Phrases:
    """The phrases of all texts; ``units`` are hashes, ``offsets`` say where texts begin and end."""
    n = len(units)
    if n < length:
        return Phrases(*[np.empty(0, np.int64)] * 4, np.empty(0, np.uint64))
    grams = sliding_hashes(units, width)
    keys = (grams >> U32 << U32) | np.arange(len(grams), dtype=np.uint64)
    chosen = (_sliding_least(keys, length - width + 1) & LOW).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.flatnonzero(text[: n - length + 1] == text[length - 1 :])
    chosen = chosen[starts]
    first = np.ones(len(starts), bool)
    first[1:] = (chosen[1:] != chosen[:-1]) | (text[starts[1:]] != text[starts[:-1]])
    at = np.flatnonzero(first)
    begin = starts[at]
    return Phrases(text[begin], begin, np.diff(np.append(at, len(starts))), chosen[at] - begin, grams[chosen[at]])


def side_keys(units: np.ndarray, start: np.ndarray, end: np.ndarray, ahead: np.ndarray, length: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each phrase's trigger with the units on its left, and on its right; 0 where the phrase is too short.

    A window has, besides its trigger, half of the rest of its units or more on one side.
    So two phrases can only share a window if they agree on one of these keys.
    """
    side = (length - width + 1) // 2
    prefix = prefix_hashes(units)
    here = start + ahead
    left, right = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
    room = here - side >= start
    left[room] = span_hashes(prefix, here[room] - side, here[room] + width)
    room = here + width + side <= end
    right[room] = mix(span_hashes(prefix, here[room], here[room] + width + side) + U64(1))
    return left, right

"""Repeated-phrase removal at word level with sharded Aho-Corasick automata.

Documents are cut into phrases around content-chosen triggers, and the phrases that could share 50 words
with another document meet in the shard of their trigger (see ``_repeats``). There

1. recurring passages are *confirmed*: windows of 50 words are counted by hash over the distinct
   phrases. A passage is a run of windows that the same phrases hold, so whatever holds one of its
   windows holds all of it; it is known by its words, as the smallest document has them, and that document;
2. the passages are compiled into pyahocorasick automata of at most ``AUTOMATON_WORDS`` words each;
3. every phrase that could hold one runs through them, and each occurrence is *located* by the automaton,
   word by word. Words go where the document's id is larger than the passage's.

Phrases keep the order of their triggers, so an automaton meets only the phrases that have its passages'
triggers. A trigger with more passages than one automaton takes has several.

Defined results: a null text has no words; texts below 50 words lose nothing; a null
doc_id neither takes nor loses; rows that repeat an id do not take from each other;
an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cotejo.llm._anchors import side_keys
from cotejo.llm._repeats import Located, Shard, Units, dedup, distinct, gathered
from cotejo.llm._text import IS_SEPARATOR, U64, mix, sliding_hashes, word_bounds, word_hashes
from cotejo.llm.suffix_dedup import _shared

LENGTH, WIDTH = 50, 8
#: Words of all passages in one automaton; about 100 bytes of memory each.
AUTOMATON_WORDS = 400_000
_MOST = np.iinfo(np.int64).max


def word_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, words = word_bounds(data, offsets)
    return word_hashes(data, starts, ends), words, starts, ends


def joined_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every text as its words, joined by one space."""
    starts, ends, words = word_bounds(data, offsets)
    keep = np.zeros(len(data), bool)
    keep[: len(data)] = ~IS_SEPARATOR[data]
    last = np.zeros(len(ends), bool)
    last[words[1:][np.diff(words) > 0] - 1] = True
    gaps = ends[~last]
    keep[gaps] = True
    spaced = data.copy()
    spaced[gaps] = 0x20
    return spaced[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def passages(numbers: np.ndarray, words: np.ndarray, least: np.ndarray, several: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, word behind the last and smallest document of every recurring passage.

    ``numbers`` are the words of distinct phrases and ``words`` their offsets; ``least`` is the smallest document
    that holds a phrase and ``several`` whether there are more.
    """
    text = np.repeat(np.arange(len(words) - 1), np.diff(words))
    start = np.flatnonzero(text[: len(numbers) - length + 1] == text[length - 1 :])
    keys = sliding_hashes(mix(numbers.astype(np.uint64) + U64(1)), length)[start]
    phrase = text[start]
    order = np.lexsort((phrase, least[phrase], keys))
    new = np.ones(len(order), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    first = np.flatnonzero(new)
    # which phrases hold a window, as a sum of hashes; and its first holder
    holders = np.add.reduceat(mix(phrase[order].astype(np.uint64) + U64(1)), first)
    recurs = np.logical_or.reduceat(several[phrase[order]], first) | (np.minimum.reduceat(least[phrase[order]], first) < np.maximum.reduceat(least[phrase[order]], first))
    chosen = first[recurs]
    at, held_by = start[order[chosen]], holders[recurs]
    by_place = np.argsort(at)
    at, held_by = at[by_place], held_by[by_place]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (text[at[1:]] != text[at[:-1]]) | (held_by[1:] != held_by[:-1])
    begin = np.flatnonzero(new)
    last = np.append(begin, len(at))[1:] - 1
    return at[begin], at[last] + length, least[text[at[begin]]]


def automata(begin: np.ndarray, end: np.ndarray, trigger: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of passages, in the order of their triggers, that fit into one automaton each.

    A range ends with a trigger, unless that trigger alone has too many.
    """
    sums = np.concatenate([[0], np.cumsum(end - begin)])
    lo = 0
    while lo < len(begin):
        hi = max(lo + 1, int(np.searchsorted(sums, sums[lo] + AUTOMATON_WORDS, "right")) - 1)
        if hi < len(begin):
            back = int(np.searchsorted(trigger, trigger[hi]))
            hi = back if back > lo else hi
        yield lo, hi
        lo = hi


def occurrences(listed: list[int], words: list[int], ranges: tuple[list[int], list[int], list[int]], phrases: range) -> Iterator[tuple[int, int, int, int]]:
    """Phrase, first word, word behind the last, and smallest document of every passage that an automaton finds in the phrases."""
    import ahocorasick

    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for begin, end, holder in zip(*ranges, strict=True):
        key = tuple(listed[begin:end])
        known = automaton.get(key, None)
        if known is None or holder < known[1]:
            automaton.add_word(key, (end - begin, holder))
    if not len(automaton):
        return
    automaton.make_automaton()
    for phrase in phrases:
        lo = words[phrase]
        for last, (n, holder) in automaton.iter(tuple(listed[lo : words[phrase + 1]])):
            yield phrase, last + 1 - n, last + 1, holder


def located(length: int, width: int):
    """Locates the recurring passages of a shard in all its phrases."""

    def locate(shard: Shard) -> Located:
        code, first = distinct(shard.data, shard.offsets)
        least, most = np.full(len(first), _MOST), np.full(len(first), np.iinfo(np.int64).min)
        np.minimum.at(least, code, shard.least)
        np.maximum.at(most, code, shard.least)
        several = least < most
        np.logical_or.at(several, code, shard.several)
        data, offsets = gathered(shard.data, shard.offsets[first], shard.offsets[first + 1])
        starts, ends, words = word_bounds(data, offsets)
        # words are numbered by their bytes
        numbers, _ = distinct(*gathered(data, starts, ends))
        units, ahead = mix(numbers.astype(np.uint64) + U64(7)), shard.ahead[first]
        left, right = (_shared(k) for k in side_keys(units, words[:-1], words[1:], ahead, length, width))
        open_ = np.flatnonzero(left | right | several)
        trigger = sliding_hashes(units, width)[words[:-1][open_] + ahead[open_]]
        order = np.argsort(trigger, kind="stable")
        open_, trigger = open_[order], trigger[order]
        numbers, own = gathered(numbers, words[open_], words[open_ + 1])
        begin, end, holder = passages(numbers, own, least[open_], several[open_], length)
        phrase_of = np.searchsorted(own, begin, "right") - 1
        listed, edges, found = numbers.tolist(), own.tolist(), []
        for lo, hi in automata(begin, end, trigger[phrase_of]):
            among = range(int(np.searchsorted(trigger, trigger[phrase_of[lo]])), int(np.searchsorted(trigger, trigger[phrase_of[hi - 1]], "right")))
            found += occurrences(listed, edges, (begin[lo:hi].tolist(), end[lo:hi].tolist(), holder[lo:hi].tolist()), among)
        at, lo, hi, holder = np.array(found, np.int64).reshape(-1, 4).T
        entry = open_[at]
        word = words[entry]
        lo, hi = starts[word + lo] - offsets[entry], ends[word + hi - 1] - offsets[entry]
        # an occurrence in a phrase is one in every block that has the phrase
        by_entry = np.argsort(code, kind="stable")
        cut = np.searchsorted(code[by_entry], np.arange(len(first) + 1))
        n = cut[entry + 1] - cut[entry]
        which = np.repeat(np.arange(len(entry)), n)
        item = by_entry[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + cut[entry][which]]
        taken = (shard.least[item] > holder[which]) | shard.several[item]
        item, which = item[taken], which[taken]
        return item, lo[which], hi[which], holder[which]

    return locate


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept words of every document."""

    def finish(data: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> list[pa.Array]:
        starts, ends, words = word_bounds(data, offsets)
        left = np.flatnonzero(~gone[starts])
        bounds = np.searchsorted(left, words)
        # each kept word with a space behind it
        if len(left):
            spaced, at = gathered(np.append(data, np.uint8(0x20)), starts[left], ends[left] + 1)
            spaced[at[1:] - 1] = 0x20
        else:
            spaced, at = np.empty(0, np.uint8), np.zeros(1, np.int64)
        raw = spaced.tobytes()
        kept = [raw[a : max(a, b - 1)] for a, b in zip(at[bounds[:-1]].tolist(), at[bounds[1:]].tolist(), strict=True)]
        n = np.diff(words)
        out = [pa.array(n), pa.array(n - np.diff(bounds)), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
        return [*out, pa.array([x.decode() for x in kept], pa.string())] if keep_text else out

    names = ["n_words", "n_removed", "kept_sha256", *["kept"] * keep_text]
    result = "n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    return dedup(docs, Units(joined_words, word_units, length, WIDTH), located(length, WIDTH), finish, result, names)

"""Best-fit packing of tokenised documents by bin completion with branch and bound.

Documents are tokenised, ended by an end token, and only those longer than a
sequence are cut. What remains to decide depends on the lengths alone, and there
are at most ``capacity`` of them: Spark counts the pieces of each length, and the
solver works on that histogram, however many documents stand behind it.

The solver takes the largest length that is left and enumerates undominated
fillings of the room around it, larger members first; the one that wastes least, best fit
among them, makes the incumbent. A filling is used as many times as the counts allow. Where
the incumbent needs more sequences than the lower bound, the search backtracks
from the end, pruning branches whose waste leaves no room for a better solution; then
groups of sequences with waste are filled anew in the same way. The search ends at the lower bound, which proves
the plan best, or when ``budget`` fillings have been looked at, ``at_once`` of them around one
length: packing is NP-hard, and the budget trades sequences for time; without one the search is exact. No document is ever left out.

The plan is laid out as runs: the pieces of one length, in order of rank, go to
consecutive sequences at one offset. Ranks are dealt in buckets (length, salt) of
about ``BUCKET_ROWS`` pieces, so no length is numbered in one task.

Defined results: a null or empty text is the end token alone; null or repeated
ids keep one piece list per row; an empty table gives an empty result; only
doc_id and text are read.
"""

from __future__ import annotations

import json
import os
import random
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cotejo.llm._session import written
from cotejo.llm._text import text_chunks

BUCKET_ROWS = 1000
#: Fillings that the solver looks at, in all and around one length.
BUDGET, AT_ONCE = 20_000, 400
NO_LIMIT = 1 << 60
#: Pieces of words whose ids a worker keeps for the next chunk.
KEPT_PIECES = 150_000
CHUNK_BYTES = 2 << 20

# Fixed value: the rule by which the tokenizers that ``PieceEncoder`` reads piecewise cut words.
WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Pieces that the rule leaves whole, and how many of them are encoded as one text: each ends with a token that ends a word.
ONE_WORD = r"^(?:\p{L}+|[0-9]|[!-&(-/:-@\[-`{-~]+)$"
WORDS_AT_ONCE = 500

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Classes of lower-cased bytes: separators, letters, digits, marks, and what never parts from its neighbours.
SEPARATOR, LETTER, DIGIT, MARK, GLUE = range(5)
CLASS = np.full(256, MARK, np.uint8)
CLASS[ord("a") : ord("z") + 1], CLASS[ord("0") : ord("9") + 1] = LETTER, DIGIT
CLASS[0x80:], CLASS[ord("'")] = GLUE, GLUE
CLASS[[0x20, *range(0x09, 0x0E)]] = SEPARATOR


class PieceEncoder:
    """Ids of whole texts, from the ids of the distinct pieces they are made of.

    A text may be cut where ASCII letters, digits and marks meet, before and after each digit,
    and at ASCII white space, for the tokenizer's own rule cuts there too; never beside
    an apostrophe or a character beyond ASCII. Each distinct piece is encoded once. Texts that
    hold a special token, and all texts for tokenizers with another rule, are encoded as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        first = ((rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        lowers = any(x.get("type") == "Lowercase" for x in (rules.get("normalizer") or {}).get("normalizers", []))
        self.piecewise = lowers and (first.get("pattern") or {}).get("Regex") == WORD_RULE
        self.special = [x["content"].encode() for x in rules["added_tokens"]]
        suffix, vocabulary = rules["model"].get("end_of_word_suffix") or "", rules["model"]["vocab"]
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[k for name, k in vocabulary.items() if suffix and name.endswith(suffix)]] = True
        self.forget()

    def forget(self, kept: np.ndarray | None = None) -> None:
        """Forgets all pieces but those at the places ``kept``."""
        names, ids, edges = ([], None, None) if kept is None else (list(self.place), self.ids, self.edges)
        self.place: dict[str, int] = {}
        self.ids = np.empty(1 << 20, np.uint32)
        self.edges = np.zeros(1 << 20, np.int64)
        self.chunks = np.zeros(1 << 20, np.int32)  # how many chunks a piece was in
        if kept is not None:
            lengths = edges[kept + 1] - edges[kept]
            source = np.repeat(edges[kept] - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))
            self._add([names[k] for k in kept.tolist()], ids[source], lengths)

    def learn(self, pieces: list[str]) -> None:
        for k in range(0, len(pieces), 10_000):
            part = pieces[k : k + 10_000]
            single = pc.match_substring_regex(pa.array(part, pa.string()), ONE_WORD).to_numpy(zero_copy_only=False)
            joined = [x for x, one in zip(part, single, strict=True) if one]
            rest = [x for x, one in zip(part, single, strict=True) if not one]
            for at in range(0, len(joined), WORDS_AT_ONCE):
                words = joined[at : at + WORDS_AT_ONCE]
                ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, np.int64)
                ends = np.flatnonzero(self.ends_word[ids]) + 1
                if len(ends) == len(words) and ends[-1] == len(ids):
                    self._add(words, ids, np.diff(ends, prepend=0))
                else:
                    rest += words
            if rest:
                found = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
                lengths = np.fromiter(map(len, found), np.int64, len(rest))
                self._add(rest, np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths)

    def _add(self, part: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n = len(self.place)
        while n + len(part) + 1 > len(self.edges):
            self.edges, self.chunks = (np.concatenate([x, np.zeros_like(x)]) for x in (self.edges, self.chunks))
        self.edges[n + 1 : n + 1 + len(part)] = self.edges[n] + np.cumsum(lengths)
        end = int(self.edges[n + len(part)])
        while end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.edges[n] : end] = ids
        self.place.update(zip(part, range(n, n + len(part)), strict=True))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and n+1 offsets of each text's."""
        raw = data.tobytes()
        whole = np.zeros(len(offsets) - 1, bool)
        if not self.piecewise:
            whole[:] = True
        elif any(x in raw for x in self.special):
            whole[:] = [any(x in raw[a:b] for x in self.special) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        if not whole.any():
            return self._by_pieces(data, offsets)
        sizes = np.where(whole, 0, np.diff(offsets))
        ids, edges = self._by_pieces(data[np.repeat(~whole, np.diff(offsets))], np.concatenate([[0], np.cumsum(sizes)]))
        texts = [raw[offsets[k] : offsets[k + 1]].decode() for k in np.flatnonzero(whole)]
        others = iter([e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        parts = [np.array(next(others), np.uint32) if w else ids[edges[k] : edges[k + 1]] for k, w in enumerate(whole)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)

    def _by_pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        data = LOWER[data]
        kind = CLASS[data]
        before, after = kind[:-1], kind[1:]
        cut = np.ones(len(data), bool)
        cut[1:] = ((before != after) & (before != GLUE) & (after != GLUE)) | (after == DIGIT) & (before == DIGIT)
        cut[1:] |= (before == SEPARATOR) | (after == SEPARATOR)
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        lengths = np.diff(np.append(starts, len(data)))
        held = kind[starts] != SEPARATOR
        starts, lengths = starts[held], lengths[held]
        edges = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(data[kind != SEPARATOR])).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        if len(self.place) > KEPT_PIECES:
            often = np.flatnonzero(self.chunks[: len(self.place)] > 1)
            self.forget(often if len(often) < KEPT_PIECES // 2 else None)
        self.learn([x for x in distinct if x not in self.place])
        known = np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))
        self.chunks[known] += 1
        place = known[pieces.indices.to_numpy()]
        first, each = self.edges[place], self.edges[place + 1] - self.edges[place]
        ends = np.cumsum(each)
        source = np.repeat(first - (ends - each), each) + np.arange(int(each.sum()))
        return self.ids[source], np.concatenate([[0], ends])[np.searchsorted(starts, offsets)].astype(np.int64)


@cache
def encoder_of(path: str) -> PieceEncoder:
    """One for each worker, which keeps it from task to task."""
    return PieceEncoder(path)


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of the pieces of every document."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for batch in batches:
            for part, data, offsets in text_chunks(batch, "text", CHUNK_BYTES):
                ids, edges = encoder.encode(data, offsets)
                edges += np.arange(len(edges))
                ended = np.full(len(ids) + len(part), end_id, "<u4")
                inner = np.ones(len(ended), bool)
                inner[edges[1:] - 1] = False
                ended[inner] = ids
                sizes = np.diff(edges)
                pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(len(part)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(sizes[row] - start, capacity)
                raw = memoryview(ended.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((edges[row] + start).tolist(), (edges[row] + start + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def _dominated(filling: list[int], waste: int, free: int) -> bool:
    """Whether some members could give way to one length in ``free`` that fills as much or more of the room.

    ``free`` has a bit for each length that is left beside the filling. Members that add up to
    a free length, two or more of them, or to as much less as is wasted, are exchanged for it
    with no loss, and what they leave behind is easier to place.
    """
    one = two = 0
    for x in filling:
        two |= two << x | one << x
        one |= one << x | 1 << x
    if two & free:
        return True
    reach, width = one << 1, 1
    while width < waste:
        step = min(width, waste - width)
        reach |= reach << step
        width += step
    return bool(waste and reach & free)


def fillings(room: int, counts: np.ndarray, budget: list[int], enough: int = -1) -> list[tuple[int, list[int]]]:
    """(waste, members) of the undominated fillings of ``room``; ``counts`` are what is left.

    Members are tried from the largest that fits downwards, each as often as it fits and then less often. A
    smaller one than the largest that fits is only tried where another fits behind it, for as the last member it would be dominated.
    ``budget`` is how many fillings are looked at: larger members come first, so best fit is among them.
    One that wastes ``enough`` or less is the last. A step takes all members of a length at once: steps
    lie as deep as a filling has distinct lengths, which is at most the square root of twice the room.
    """
    lengths = [int(x) for x in np.flatnonzero(counts[: room + 1])[::-1] if x]
    if not lengths:
        return [(room, [])]
    left = {x: int(counts[x]) for x in lengths}
    smallest = lengths[-1]
    place = np.searchsorted(-np.array(lengths), -np.arange(room + 1)).tolist()
    free = sum(1 << x for x in lengths)
    found: list[tuple[int, list[int]]] = []

    def search(room: int, at: int, chosen: list[int], skipped: bool) -> bool:
        """``skipped``: a larger one than those from ``at`` on would fit. Returns whether the filling without waste that ends the branch was found."""
        nonlocal free
        first = max(at, place[room])
        while first < len(lengths) and not left[lengths[first]]:
            first += 1
        if first == len(lengths):
            if skipped:
                return False
            budget[0] -= 1
            # the first leaf is best fit; behind it only what is not dominated counts
            if found and _dominated(chosen, room, free):
                return False
            found.append((room, list(chosen)))
            return not room
        for k in range(first, len(lengths)):
            x = lengths[k]
            if not left[x] or (skipped or k > first) and room - x < smallest:
                continue
            had = left[x]
            most = times = min(had, room // x)
            while times:
                left[x] = had - times
                free = free & ~(1 << x) if times == had else free | 1 << x
                chosen.extend([x] * times)
                full = search(room - times * x, k + 1, chosen, times < most)
                del chosen[len(chosen) - times :]
                left[x] = had
                free |= 1 << x
                if budget[0] <= 0 or found and found[-1][0] <= enough:
                    return False
                # what the last of them fills alone is not filled with smaller ones
                times -= 2 if full and room == times * x else 1
                if times < 0:
                    return False
        return False

    search(room, 0, [], False)
    return found


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No packing has fewer sequences: total size, and large lengths that cannot share."""
    n = counts.astype(object)
    total = sum(int(x) * k for k, x in enumerate(n))
    best = -(-total // capacity)
    tail, suffix = 0, [0] * (capacity + 2)
    for k in range(capacity, -1, -1):
        tail += int(n[k])
        suffix[k] = tail
    middle = [0] * (capacity + 2)
    for k in range(capacity + 1):
        middle[k + 1] = middle[k] + int(n[k]) * k
    for t in range(0, capacity // 2 + 1):
        large = suffix[capacity - t + 1]
        half = suffix[capacity // 2 + 1] - large
        room = half * capacity - (middle[capacity - t + 1] - middle[capacity // 2 + 1])
        small = middle[capacity // 2 + 1] - middle[t]
        best = max(best, large + half + max(0, -(-(small - room) // capacity)))
    return best


Plan = list[tuple[int, list[int]]]


def _search(counts: np.ndarray, capacity: int, spent: list[int], at_once: int, mixed: random.Random | None = None, enough: int = -1, exact: bool = False) -> Plan:
    """The best plan that branch and bound finds until its budget of fillings is spent; the first descent is always finished.

    A filling is used as often as the counts allow; if ``exact``, also less often.
    """
    bound = lower_bound(counts, capacity)
    best: Plan = []
    best_bins = None
    # one histogram, which steps take from and give back to: the stack may be deeper than ``capacity``
    left, pieces, size = counts.copy(), int(counts.sum()), int((counts * np.arange(len(counts))).sum())

    def around(largest: int) -> list[tuple[int, list[int]]]:
        rest = left.copy()
        rest[largest] -= 1
        own = [at_once]
        found = fillings(capacity - largest, rest, own, enough) if capacity > largest else [(0, [])]
        spent[0] -= at_once - own[0] + 1
        # of equal waste first what leaves the lengths most even, or by chance
        found.sort(key=lambda f: (f[0], mixed.random() if mixed else -min((rest[x] for x in f[1]), default=0)))
        return found

    def options() -> Iterator[tuple[int, list[int]]]:
        largest = int(np.flatnonzero(left)[-1])
        for _, filling in around(largest):
            members = [largest, *filling]
            most = min(int(left[x]) // n for x, n in Counter(members).items())
            for times in range(most, 0, -1) if exact else (most,):
                yield times, members

    def take(times: int, members: list[int]) -> None:
        nonlocal pieces, size
        for x in members:
            left[x] -= times
        pieces -= times * len(members)
        size -= times * sum(members)

    stack = [(options(), 0)] if counts.any() else []
    path: Plan = []
    while stack:
        choices, bins = stack[-1]
        step = next(choices, None)
        if step is None:
            stack.pop()
            if path:
                times, members = path.pop()
                take(-times, members)
            continue
        times, members = step
        now = bins + times
        if best_bins is not None and now + -(-(size - times * sum(members)) // capacity) >= best_bins:
            continue
        if pieces == times * len(members):
            best, best_bins = [*path, step], now
            if now <= bound:
                break
            continue
        path.append(step)
        take(times, members)
        stack.append((options(), now))
        if best_bins is not None and spent[0] <= 0:
            break
    return best


def _sequences(plan: Plan) -> int:
    return sum(n for n, _ in plan)


def _improved(plan: Plan, capacity: int, bound: int, spent: list[int], at_once: int) -> Plan:
    """``plan`` with groups of sequences, the wasteful ones first, filled anew as long as the budget lasts."""
    mixed, held = random.Random(7), Counter()
    for n, members in plan:
        held[tuple(members)] += n
    while sum(held.values()) > bound and spent[0] > 0:
        wasteful = [m for m in held if sum(m) < capacity]
        full = [m for m in held if sum(m) == capacity]
        group = mixed.sample(wasteful, min(len(wasteful), mixed.randint(2, 6))) + mixed.sample(full, min(len(full), mixed.randint(2, 12)))
        counts = np.bincount([x for m in group for x in m], minlength=capacity + 1)
        own = [min(spent[0], 8 * at_once)]
        spent[0] -= own[0]
        again = _search(counts, capacity, own, at_once, mixed)
        spent[0] += max(0, own[0])
        filled = lambda ms: sum((capacity - sum(m)) ** 2 * n for n, m in ms)
        # fewer sequences, or as many with the waste gathered in fewer of them
        if (_sequences(again), -filled(again)) <= (len(group), -filled([(1, m) for m in group])):
            held -= Counter(group)
            for n, m in again:
                held[tuple(m)] += n
    return [(n, list(m)) for m, n in held.items()]


def complete_bins(counts: np.ndarray, capacity: int, budget: int | None = BUDGET, at_once: int = AT_ONCE) -> Plan:
    """(how many, members) of the sequences that hold all of ``counts``, by length.

    No plan has fewer than ``lower_bound``. The incumbent takes the first filling without waste
    around each length. Where it ends above the bound, half of the budget goes into branch and bound
    over all fillings, and half into filling groups of the better plan's sequences anew. Without a budget (None)
    branch and bound goes on, over all fillings, until no plan can be better: exact, and as slow as the problem is hard.
    """
    counts = counts.astype(np.int64)
    bound = lower_bound(counts, capacity)
    if budget is None:
        return _search(counts, capacity, [NO_LIMIT], NO_LIMIT, exact=True)
    plan = _search(counts, capacity, [0], at_once, enough=0)
    if _sequences(plan) > bound:
        plan = min(_search(counts, capacity, [budget // 2], at_once), plan, key=_sequences)
    return plan if _sequences(plan) <= bound else _improved(plan, capacity, bound, [budget // 2], at_once)


def layout(plan: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """Runs of the plan, sorted by length and first rank: where the pieces of a length go."""
    seen: dict[int, int] = {}
    rows, sequence = [], 0
    for times, members in plan:
        offset = 0
        for x in members:
            rows.append((x, seen.get(x, 0), sequence, offset))
            seen[x] = seen.get(x, 0) + times
            offset += x
        sequence += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 4).T
    return dict(zip(("length", "first", "sequence", "offset"), columns, strict=True))


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 0, budget: int | None = BUDGET, at_once: int = AT_ONCE) -> DataFrame:
    """The pieces of all documents with the sequence that each goes to and its place there.

    ``budget`` and ``at_once`` are those of ``complete_bins``; without a budget no plan has fewer sequences.
    """
    spark = docs.sparkSession
    pieces = written(cut_pieces(docs, tokenizer, capacity, end_id), "pack-pieces")
    # at most ``capacity`` rows, whatever the corpus
    histogram = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()
    counts = np.zeros(capacity + 1, np.int64)
    for row in histogram:
        counts[row["length"]] = row["n"]
    runs = spark.sparkContext.broadcast(layout(complete_bins(counts, capacity, budget, at_once)))
    dealt = spark.createDataFrame([(r["length"], r["n"] // BUCKET_ROWS + 1) for r in histogram], "length long, salts long")
    salted = pieces.join(F.broadcast(dealt), "length").withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts"))
    )
    by_salt = Window.partitionBy("length", "block").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    by_block = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    buckets = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("salt") / BUCKET_ROWS))
    blocks = buckets.groupBy("length", "block").agg(F.sum("n").alias("n")).select("length", "block", F.coalesce(F.sum("n").over(by_block), F.lit(0)).alias("before_block"))
    before = buckets.withColumn("before_salt", F.coalesce(F.sum("n").over(by_salt), F.lit(0))).join(blocks, ["length", "block"])
    before = written(before.select("length", "salt", (F.col("before_block") + F.col("before_salt")).alias("before")), "pack-ranks")
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("nth", nth).join(before, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth") - 1).alias("rank"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = runs.value
        spans = np.searchsorted(table["length"], np.arange(capacity + 2))
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run = np.empty(len(length), np.int64)
            for x in np.unique(length):
                here = length == x
                lo, hi = spans[x], spans[x + 1]
                run[here] = lo + np.searchsorted(table["first"][lo:hi], rank[here], "right") - 1
            sequence = table["sequence"][run] + rank - table["first"][run]
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(table["offset"][run])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(placed, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

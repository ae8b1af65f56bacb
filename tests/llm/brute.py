"""Plain single-process versions of the operators that SQL cannot express, for small fixtures."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_rules(text: str | None) -> dict:
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": dup,
        "n_repeat_words": len(covered),
        "base_failed": len(words) < 20 or 100 * len(covered) > 30 * len(words),
    }


def _covered(docs: dict[int, list], length: int) -> dict[int, list[bool]]:
    """Which units lie in a window that also starts in a document with a smaller id."""
    least: dict = {}
    for doc_id in sorted(docs):
        units = docs[doc_id]
        for i in range(len(units) - length + 1):
            least.setdefault(hashlib.md5(repr(units[i : i + length]).encode()).digest(), doc_id)
    out = {}
    for doc_id, units in docs.items():
        gone, last = [False] * len(units), -1
        for i in range(len(units) - length + 1):
            if least[hashlib.md5(repr(units[i : i + length]).encode()).digest()] < doc_id:
                gone[max(i, last) : i + length] = [True] * (i + length - max(i, last))
                last = i + length
        out[doc_id] = gone
    return out


def repeated_words(docs: dict[int, str | None], length: int = 50) -> dict[int, tuple[int, int, str]]:
    words = {k: WORD.findall(t or "") for k, t in docs.items()}
    gone = _covered(words, length)
    return {k: (len(w), sum(gone[k]), hashlib.sha256(" ".join(x for x, g in zip(w, gone[k], strict=True) if not g).encode()).hexdigest()) for k, w in words.items()}


def repeated_bytes(docs: dict[int, str | None], length: int = 50) -> dict[int, tuple[int, int, int, str]]:
    data = {k: (t or "").encode() for k, t in docs.items()}
    gone = _covered(data, length)
    out = {}
    for k, d in data.items():
        spans = sum(g and not (i and gone[k][i - 1]) for i, g in enumerate(gone[k]))
        out[k] = (len(d), sum(gone[k]), spans, hashlib.sha256(bytes(x for x, g in zip(d, gone[k], strict=True) if not g)).hexdigest())
    return out


def components(ids: list[int], links: list[tuple[int, int]]) -> dict[int, int]:
    root = {i: i for i in ids}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text: str | None, width: int = 2) -> set[tuple[str, ...]]:
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def near_groups(docs: dict[int, str | None], width: int = 2, percent: int = 80) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component_id), through an inverted index."""
    sets = {k: shingles(t, width) for k, t in docs.items()}
    index: dict = {}
    links = []
    for k in sorted(sets):
        shared: Counter = Counter()
        for s in sets[k]:
            held = index.setdefault(s, [])
            shared.update(held)
            held.append(k)
        links += [(o, k) for o, n in shared.items() if 100 * n >= percent * (len(sets[k]) + len(sets[o]) - n)]
    root = components(list(sets), links)
    return {k: (len(sets[k]), root[k]) for k in sets}


def kneser_ney(counts: dict[tuple, int], order: int, uniform: float):
    """p(gram) of an interpolated modified Kneser-Ney model, from counts of full n-grams; by dictionaries."""
    levels = [Counter() for _ in range(order)]
    levels[order - 1] = Counter(counts)
    for k in range(order - 2, -1, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cuts, totals, backs = [], [], []
    for level in levels:
        of = [sum(n == j for n in level.values()) for j in (1, 2, 3, 4)]
        y = of[0] / max(1, of[0] + 2 * of[1])
        cut = [0.0] + [min(j, max(0.0, j - (j + 1) * y * of[j] / of[j - 1])) if of[j - 1] and of[j] else 0.5 for j in (1, 2, 3)]
        total, back = Counter(), Counter()
        for g, n in level.items():
            total[g[:-1]] += n
            back[g[:-1]] += cut[min(n, 3)]
        cuts.append(cut), totals.append(total), backs.append(back)

    def p(gram: tuple) -> float:
        if not gram:
            return uniform
        k, context = len(gram) - 1, gram[:-1]
        if context not in totals[k]:
            return p(gram[1:])
        n = levels[k][gram]
        return (n - cuts[k][min(n, 3)]) / totals[k][context] + backs[k][context] / totals[k][context] * p(gram[1:])

    return p


def folded(text: str) -> list[str]:
    """Characters in lower case, where that is one character, and all white space as a space."""
    return [" " if c in "\x00\t\n\v\f\r " else c.lower() if len(c.lower()) == 1 else c for c in text]


def perplexity_verdicts(rows: list[tuple], order: int, width: float, least: float, step: float, spread_step: float) -> dict:
    """doc_id -> whether a text's perplexity lies in its language's band; rows are (doc_id, text, lang), texts not empty."""
    grams = {k: [tuple(c) for c in zip(*[([" "] * (order - 1) + folded(t))[j:] for j in range(order)], strict=False)] for k, t, _ in rows}
    models = {}
    for lang in {r[2] for r in rows}:
        models[lang] = kneser_ney(Counter(g for k, _, x in rows if x == lang for g in grams[k]), order, 2.0**-16)
    cost = {k: -sum(math.log(models[x](g)) for g in grams[k]) / len(grams[k]) for k, _, x in rows}

    def median(values: list[float], step: float) -> float:
        steps = sorted(math.floor(v / step + 0.5) * step for v in values)
        return steps[(len(steps) - 1) // 2]

    out = {}
    for lang in models:
        mine = [k for k, _, x in rows if x == lang]
        middle = median([cost[k] for k in mine], step)
        spread = 1.4826 * median([abs(cost[k] - middle) * math.sqrt(len(grams[k])) for k in mine], spread_step)
        for k in mine:
            out[k] = abs(cost[k] - middle) <= least + width * spread / math.sqrt(len(grams[k]))
    return out


def ppm_bits(learned: list[bytes], text: bytes, order: int = 3) -> float:
    """Code length of a text under frozen counts of contexts up to ``order`` bytes, escape method C; zero bytes stand before a text."""
    seen: dict[bytes, Counter] = {}
    for t in learned:
        padded = bytes(order) + t
        for i in range(order, len(padded)):
            for k in range(order + 1):
                seen.setdefault(padded[i - k : i], Counter())[padded[i]] += 1
    # contexts of different orders never share a key, for keys differ in length
    bits, padded = 0.0, bytes(order) + text
    for i in range(order, len(padded)):
        for k in range(order, -1, -1):
            held = seen.get(padded[i - k : i])
            if held is None:
                continue
            mass = sum(held.values()) + len(held)
            if padded[i] in held:
                bits -= math.log2(held[padded[i]] / mass)
                break
            bits -= math.log2(len(held) / mass)
        else:
            bits += 8
    return bits


def targets(sizes: dict, weights: tuple = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> dict:
    """Target of each source: by weight, cut at ``cap`` times its size, the excess dealt out again until nothing is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    free, cut = set(order), set()
    while True:
        left = share * sum(sizes.values()) - sum(cap * sizes[s] for s in cut)
        level = left / sum(weight[s] for s in free) if free else 0.0
        above = {s for s in free if weight[s] * level > cap * sizes[s]}
        if not above:
            return {s: cap * sizes[s] if s in cut else weight[s] * level for s in order}
        free, cut = free - above, cut | above

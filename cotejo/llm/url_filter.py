"""URL filters by a bit-parallel wildcard automaton.

Glob rules are packed side by side into the bits of a row of 64-bit words: one
bit for each state of each rule. Reading a character moves all rules at once
(Shift-And): ``state = ((state << 1) & literal[c]) | (state & loop[c])``, where
``literal[c]`` has the states that are entered by ``c`` and ``loop[c]`` those that
a wildcard keeps. All URLs of an Arrow batch advance together, longest first, so
the work is the sum of their lengths times the number of words.

``*`` stands for any run of characters without ``/``, ``**`` for any run, ``?`` for
one character other than ``/``. A URL is matched in its canonical form: lower-cased host and then the path.

A host rule ``(host, path)`` fits the host and its subdomains where the path
starts with its path; it becomes the globs ``host path**`` and ``*.host path**``.
The longest rule that fits decides; where none fits, the URL is blocked if a
block glob matches, else allowed.

Defined results: a URL that is null or has no ``://`` has an empty host and path
and is allowed by no rule; an empty table gives an empty result; only page_id and url are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


HOST_RULES = (
    HostRule("block", "net", "/"),
    HostRule("allow", "example.net", "/en/"),
    HostRule("block", "example.com", "/de/"),
    HostRule("allow", "org", "/fr/"),
)
#: What the method blocks besides: pages of shops for pills, casinos, logins, carts, feeds and files that aren't pages.
BLOCK_GLOBS = (
    "*pills*/**",
    "*casino*/**",
    "*/**/login",
    "*/login",
    "*/**/cart",
    "*/**.exe",
    "*/**.zip",
    "*/**.pdf",
    "ads.*/**",
    "*.ads.*/**",
)


class GlobAutomaton:
    """All globs as one NFA, its states packed into ``n_words`` 64-bit words."""

    OTHER = 128  # the class of all characters beyond ASCII

    def __init__(self, globs: Sequence[str]):
        items = [self._items(g) for g in globs]
        n_states = sum(len(literals) + 1 for literals, _ in items)
        self.n_words = max(1, -(-n_states // 64))
        self.literal = np.zeros((self.OTHER + 1, self.n_words), np.uint64)
        self.loop = np.zeros((self.OTHER + 1, self.n_words), np.uint64)
        self.start = np.zeros(self.n_words, np.uint64)
        self.final: list[tuple[int, int]] = []
        at = 0
        for literals, loops in items:
            self._set(self.start, at)
            for k in range(len(literals) + 1):
                for c in self._classes(loops.get(k)):
                    self._set(self.loop[c], at + k)
                if k:
                    for c in self._classes(literals[k - 1]):
                        self._set(self.literal[c], at + k)
            at += len(literals)
            self.final.append(divmod(at, 64))
            at += 1

    @staticmethod
    def _set(row: np.ndarray, bit: int) -> None:
        row[bit // 64] |= np.uint64(1 << (bit % 64))

    @staticmethod
    def _items(glob: str) -> tuple[list[str], dict[int, str]]:
        """The glob's single-character items, and the wildcard, if any, before each of them or the end."""
        literals: list[str] = []
        loops: dict[int, str] = {}
        i = 0
        while i < len(glob):
            if glob[i] == "*":
                run = len(glob[i:]) - len(glob[i:].lstrip("*"))
                loops[len(literals)] = "**" if run > 1 or loops.get(len(literals)) == "**" else "*"
                i += run
            else:
                literals.append(glob[i])
                i += 1
        return literals, loops

    def _classes(self, item: str | None) -> list[int]:
        if item is None:
            return []
        if item in ("*", "?"):
            return [c for c in range(self.OTHER + 1) if c != ord("/")]
        return list(range(self.OTHER + 1)) if item == "**" else [ord(item)]

    def matches(self, texts: Sequence[str]) -> np.ndarray:
        """bool[text, glob]: which globs match which whole texts."""
        n = len(texts)
        lengths = np.fromiter(map(len, texts), np.int64, n)
        order = np.argsort(-lengths, kind="stable")
        codes = np.frombuffer("".join(texts[i] for i in order).encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = np.minimum(codes, self.OTHER)
        begin = np.concatenate([[0], np.cumsum(lengths[order])[:-1]]).astype(np.int64) if n else np.empty(0, np.int64)
        # at step j the texts longer than j come first
        alive = n - np.searchsorted(lengths[order][::-1], np.arange(lengths.max(initial=0)), "right")
        state = np.tile(self.start, (n, 1))
        for j, m in enumerate(alive):
            c = classes[begin[:m] + j]
            now = state[:m]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:m] = (moved & self.literal[c]) | (now & self.loop[c])
        out = np.empty((n, len(self.final)), bool)
        for g, (word, bit) in enumerate(self.final):
            out[order, g] = (state[:, word] >> np.uint64(bit)) & np.uint64(1) == 1
        return out


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(
    pages: DataFrame, host_rules: Sequence[HostRule] = HOST_RULES, block_globs: Sequence[str] = BLOCK_GLOBS
) -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict of every page."""
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    id_type = parsed.schema["page_id"].dataType.simpleString()
    globs = [g for r in host_rules for g in (f"{r.host}{r.path}**", f"*.{r.host}{r.path}**")]
    longest_first = sorted(range(len(host_rules)), key=lambda k: -len(host_rules[k].name))
    host_rules, block_globs = tuple(host_rules), tuple(block_globs)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = GlobAutomaton([*globs, *block_globs])
        for batch in batches:
            texts = [h + p for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            hits = automaton.matches(texts)
            rule = np.full(len(texts), None, object)
            verdict = np.where(hits[:, len(globs) :].any(axis=1), "block", "allow").astype(object)
            for k in reversed(longest_first):
                fits = hits[:, 2 * k] | hits[:, 2 * k + 1]
                rule[fits], verdict[fits] = host_rules[k].name, host_rules[k].verdict
            columns = [batch.column(c) for c in ("page_id", "host", "path")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return parsed.mapInArrow(judged, f"page_id {id_type}, host string, path string, rule string, verdict string")


def _glob_regex(glob: str) -> str:
    import re

    return "(?s)^" + "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(x, re.escape(x)) for x in re.findall(r"\*\*+|.", glob)) + "$"


ORACLE = (
    r"""
WITH parsed AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (SELECT *, CASE """
    + " ".join(
        f"WHEN (host = '{r.host}' OR suffix(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}'"
        for r in sorted(HOST_RULES, key=lambda r: -len(r.name))
    )
    + " END AS rule FROM parsed) SELECT page_id, host, path, rule, CASE rule "
    + " ".join(f"WHEN '{r.name}' THEN '{r.verdict}'" for r in HOST_RULES)
    + " ELSE CASE WHEN "
    + " OR ".join(f"regexp_matches(host || path, '{_glob_regex(g)}')" for g in BLOCK_GLOBS)
    + " THEN 'block' ELSE 'allow' END END AS verdict FROM ruled"
)

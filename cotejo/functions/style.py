"""Features of writing style, and a probability of synthetic origin made of them. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from cotejo.functions.text import KEYWORDS, without_comments

CONTROL = ("if", "for", "while", "switch")
# Java's word boundary knows letters beyond ASCII, its word characters do not: so both ends are spelled out
_START, _END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _ratio(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)), 6)


def _is(word: str) -> Callable[[Column], Column]:
    return lambda x: x == word


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def nesting(text: Column) -> Column:
    """Mean depth of braces over the opening ones."""
    braces = F.regexp_extract_all(text, F.lit(r"[{}]"), F.lit(0))
    walked = F.aggregate(
        braces,
        F.struct(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.when(x == "{", F.struct((a["depth"] + 1).alias("depth"), (a["sum"] + a["depth"] + 1).alias("sum"), (a["n"] + 1).alias("n"))).otherwise(
            F.struct(F.greatest(a["depth"] - 1, F.lit(0)).alias("depth"), a["sum"].alias("sum"), a["n"].alias("n"))
        ),
    )
    return _ratio(walked["sum"], walked["n"])


def runs_of(text: Column) -> Column:
    """All runs of letters, digits and underscores."""
    return F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0))


def style_features(text: Column, runs: Column | None = None) -> dict[str, Column]:
    """Name to column; a null text has null features.

    ``runs`` are those of ``runs_of``; where they are a column of a step before, they are found once for all features.
    """
    runs = runs_of(text) if runs is None else runs
    count = lambda test: F.size(F.filter(runs, test)).cast("long")
    # what is left of a run without leading digits is a name or a keyword
    name = lambda x: F.ltrim(x, F.lit("0123456789"))
    chars = F.aggregate(runs, F.lit(0).cast("long"), lambda a, x: a + F.length(name(x)))
    by_line = lines(text)
    blank = F.size(F.filter(by_line, lambda x: F.trim(x) == "")).cast("long")
    by_kind = {c: count(_is(c)) for c in CONTROL}
    control = by_kind["if"] + by_kind["for"] + by_kind["while"] + by_kind["switch"]
    out = {
        "n_chars": F.length(text).cast("long"),
        "n_lines": F.size(by_line).cast("long"),
        "n_keywords": count(lambda x: x.isin(*KEYWORDS)),
        "n_operators": _count(text, r"[-+*/%=<>!&|^~]"),
        "mean_token": _ratio(chars, count(lambda x: name(x) != "")),
    }
    out |= {f"share_{c}": _ratio(by_kind[c], control) for c in CONTROL}
    out |= {
        "mean_nesting": nesting(text),
        "n_functions": _count(text, _START + r"(?!(?:if|for|while|switch|catch)" + _END + r")[A-Za-z_]\w*\s*\([^(){};]*\)\s*\{"),
        "space_indent": F.size(F.filter(by_line, lambda x: F.startswith(x, F.lit(" ")))).cast("long"),
        "tab_indent": F.size(F.filter(by_line, lambda x: F.startswith(x, F.lit("\t")))).cast("long"),
        "blank_lines": _ratio(blank, F.size(by_line)),
        "same_line_braces": _count(text, r"\)[ \t]*\{"),
        "own_line_braces": _count(text, r"\n[ \t]*\{"),
        "comment_density": _ratio(F.length(text) - F.length(without_comments(text)), F.length(text)),
        "leading_comment": text.rlike(r"^\s*(?://|/\*)"),
        "camel_names": count(lambda x: x.rlike("^[a-z]+(?:[A-Z][a-z0-9]*)+$")),
        "snake_names": count(lambda x: F.contains(x, F.lit("_")) & x.rlike("^[a-z0-9]+(?:_[a-z0-9]+)+$")),
    }
    return out


#: Weights of the stand-in for a trained style model; any column in [0, 1] may take its place.
WEIGHTS: Mapping[str, float] = {"bias": -1.0, "comment_density": 3.0, "blank_lines": 2.0, "mean_token": 0.1, "own_line_braces": -0.05, "tab_indent": -0.02}


def synthetic_probability(features: Mapping[str, Column], weights: Mapping[str, float] = WEIGHTS) -> Column:
    """Logistic function of weighted features."""
    score = F.lit(float(weights["bias"]))
    for name, w in weights.items():
        if name != "bias":
            score = score + F.lit(float(w)) * features[name].cast("double")
    return F.round(1 / (1 + F.exp(-score)), 6)


def style_weight(n_chars: Column, least: int = 200, weight: float = 0.5) -> Column:
    """How much the style channel counts: texts below ``least`` characters are weak evidence."""
    return F.when(n_chars < least, F.lit(weight)).otherwise(F.lit(1.0))


def char_codes(text: Column, alphabet: str) -> Column:
    """Places of a text's characters in an alphabet, from 1; 0 for others."""
    places = F.create_map(*[F.lit(x) for k, c in enumerate(alphabet, 1) for x in (c, k)])
    return F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(places, c), F.lit(0)))


def char_ngrams(text: Column, n: int) -> Column:
    """All runs of ``n`` characters; the array of characters is shifted against itself, which takes linear time."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return runs(chars, n, lambda xs: F.concat(*xs))


def runs(values: Column, n: int, combine: Callable[[list[Column]], Column]) -> Column:
    """``combine`` of each run of ``n`` neighbours in an array."""
    count = F.greatest(F.size(values) - (n - 1), F.lit(0))
    shifted = [F.slice(values, F.lit(k + 1), count).alias(f"x{k}") for k in range(n)]
    return F.transform(F.arrays_zip(*shifted), lambda z: combine([z[f"x{k}"] for k in range(n)]))

"""Column functions on names, prompts, answers and code. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lengths of excerpts, in code points.
SAMPLE_CHARS, ORIGINAL_CHARS, FALLBACK_CHARS = 2000, 1500, 100

# The two prompts, split where the inputs go.
STATEMENT_PROMPT = (
    "Analiza estos códigos de estudiantes que resuelven el mismo problema.\n"
    "Infiere cuál es el enunciado/tarea original basándote en el código.\n"
    "Solo responde con el enunciado inferred y el lenguaje de programación.\n\nCódigo 1:\n",
    "\n\nCódigo 2:\n",
    '\n\nResponde en formato: "Enunciado: X | Lenguaje: Y"\n',
)
REFERENCE_PROMPT = (
    'Given this problem description: "',
    '"\nAnd this original solution:\n```c\n',
    "\n```\n\nGenerate a functionally equivalent code but with a DIFFERENT implementation approach.\n"
    "Do NOT copy the logic directly - use alternative algorithms where possible.\n"
    "The output should be clean, compilable C code.\n",
)
# Marks of errors that are worth another try, and the waits between tries in seconds.
RETRYABLE = ("RateLimitError", "429", "RESOURCE_EXHAUSTED", "ServiceUnavailableError", "503", "UNAVAILABLE")
FIRST_WAIT, MAX_RETRIES = 30, 5

KEYWORDS = (
    "auto break case char const continue default do double else enum extern float for goto if inline int long register "
    "restrict return short signed sizeof static struct switch typedef union unsigned void volatile while bool catch class "
    "constexpr delete explicit export false friend mutable namespace new noexcept nullptr operator private protected public "
    "static_cast template this throw true try typename using virtual"
).split()


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def valid_utf8(content: Column) -> Column:
    """Bytes as text, invalid ones dropped; genuine U+FFFD go with them."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def model_of(file_name: Column) -> Column:
    """Model in ``referencia_v{n}_{model}.c``: what follows the last ``_``; null without one."""
    stem = F.regexp_replace(file_name, r"\.[^.]*$", "")
    parts = F.split(F.replace(stem, F.lit("referencia_v"), F.lit("")), "_")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -1))


def version_of(file_name: Column) -> Column:
    return F.nullif(F.regexp_extract(file_name, r"^referencia_v(\d{1,9})_", 1), F.lit("")).cast("int")


def reference_name(version: Column, model: Column) -> Column:
    return F.concat(F.lit("referencia_v"), version.cast("string"), F.lit("_"), model, F.lit(".c"))


def statement_prompt(code1: Column, code2: Column) -> Column:
    a, b, c = map(F.lit, STATEMENT_PROMPT)
    return F.concat(a, F.left(code1, F.lit(SAMPLE_CHARS)), b, F.left(F.coalesce(code2, F.lit("")), F.lit(SAMPLE_CHARS)), c)


def reference_prompt(statement: Column, original: Column) -> Column:
    a, b, c = map(F.lit, REFERENCE_PROMPT)
    return F.concat(a, statement, b, F.left(original, F.lit(ORIGINAL_CHARS)), c)


def parse_statement(answer: Column) -> tuple[Column, Column]:
    """Statement and language of a model's answer.

    With a ``|`` the first two parts are read; else the last line that begins with each
    mark. The language is C, and the statement the first 100 characters, where none is found.
    """
    text = strip(answer)
    part = lambda k, mark: strip(F.replace(F.split_part(text, F.lit("|"), F.lit(k)), F.lit(mark), F.lit("")))

    def line(mark: str) -> Column:
        found = F.filter(F.split(text, "\n"), lambda x: F.startswith(x, F.lit(mark)))
        return strip(F.replace(F.try_element_at(found, F.lit(-1)), F.lit(mark), F.lit("")))

    piped = F.contains(text, F.lit("|"))
    fallback = F.left(text, F.lit(FALLBACK_CHARS))
    statement = F.when(piped, part(1, "Enunciado:")).otherwise(F.coalesce(F.nullif(line("Enunciado:"), F.lit("")), fallback))
    return statement, F.when(piped, part(2, "Lenguaje:")).otherwise(F.coalesce(line("Lenguaje:"), F.lit("C")))


def fenced_code(answer: Column, compat: bool = False) -> Column:
    """What stands in the first code fence, or the whole answer without one.

    The language after the fence is dropped, in any case; ``compat`` knows ``c`` only, and
    so leaves the rest of other names in the code.
    """
    if compat:
        opened = F.when(F.contains(answer, F.lit("```c")), F.lit("```c")).otherwise(F.lit("```"))
        inside = F.split_part(F.split_part(answer, opened, F.lit(2)), F.lit("```"), F.lit(1))
        return strip(F.when(F.contains(answer, F.lit("```")), inside).otherwise(answer))
    inside = F.split_part(F.split_part(answer, F.lit("```"), F.lit(2)), F.lit("```"), F.lit(1))
    return strip(F.when(F.contains(answer, F.lit("```")), F.regexp_replace(inside, r"^(?i:c\+\+|cpp|cc|cxx|c)(?=\s)", "")).otherwise(answer))


def is_retryable(error: Column) -> Column:
    return F.exists(F.array(*map(F.lit, RETRYABLE)), lambda x: F.contains(error, x))


def retry_wait(retry: Column) -> Column:
    return (FIRST_WAIT * F.pow(F.lit(2), retry)).cast("long")


def flattened(messages: Column) -> tuple[Column, Column]:
    """The last system and the last user message of array<struct<role, content>>."""
    last = lambda role: F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(-1))["content"]
    return last("system"), last("user")


_LITERAL = r'("(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\')'


def without_comments(code: Column) -> Column:
    """Code without comments; what looks like one inside a literal stays."""
    return F.regexp_replace(code, _LITERAL + r"|//[^\n]*|/\*(?s:.*?)\*/", "$1")


def normalized_layout(code: Column) -> Column:
    """Without comments, runs of white space as one space: equal for copies of type I."""
    return strip(F.regexp_replace(without_comments(code), r"\s+", " "))


def normalized(code: Column, keywords: Sequence[str] = KEYWORDS) -> Column:
    """``normalized_layout`` with identifiers that are no keywords as ``ID``: equal for copies of type II."""
    tokens = F.regexp_extract_all(normalized_layout(code), F.lit(r"(?s)" + _LITERAL + r"|[A-Za-z_]\w*|\d\w*|."), F.lit(0))
    is_name = lambda x: x.rlike(r"^[A-Za-z_]") & ~x.isin(*keywords)
    return F.array_join(F.transform(tokens, lambda x: F.when(is_name(x), F.lit("ID")).otherwise(x)), "")


def is_recoverable(code: Column) -> Column:
    """Code that is not empty without comments and has as many closing braces as opening ones."""
    text = without_comments(code)
    return (strip(text) != "") & (F.regexp_count(text, F.lit(r"\{")) == F.regexp_count(text, F.lit(r"\}")))


def content_hash(code: Column) -> Column:
    return F.sha2(normalized_layout(code), 256)

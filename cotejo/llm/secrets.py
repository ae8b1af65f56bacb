"""Secret scans over an incremental blob ledger, in DataFrame functions only.

A text is a *blob*, addressed by the SHA-256 of its content. Each rule has a version, the
digest of its definition. The ledger is a table of (blob, rules, spans): under which rule
versions a blob was scanned, and what was found. A scan reads only the blobs of which a
pair with a rule version is not in the ledger yet, applies only the rules that are missing, adds
what it did, and joins the findings back to every path (here: row) that holds the
blob. So copies and old versions cost nothing again, and a changed rule costs only itself.

A span is ``kind:start:end`` in code points, end exclusive. Positions come from
splitting a text by a rule and adding up the lengths of the pieces and matches,
``TOGETHER`` matches at a time, so that the work grows with their number.

Defined results: a null text is an empty blob without spans; equal texts share
one scan, whatever their ids; null or repeated ids keep their rows; an empty
table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotejo.llm._session import new_table_path, written


@dataclass(frozen=True)
class Rule:
    """Leftmost, non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Kinds that the method adds; their spans never replace one of the base rules.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = (*BASE_RULES, *MORE_RULES)
TOGETHER = 128
SPANS = "array<struct<start:int,end:int,rule:string,kind:string>>"


def rule_version(rule: Rule) -> str:
    return hashlib.sha256(repr(rule).encode()).hexdigest()[:16]


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<start, end, rule, kind>> of one rule's spans in ``text``."""
    none = F.expr(f"cast(array() as {SPANS})")
    pieces = F.transform(F.split(text, rule.pattern, -1), F.length)
    matches = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.length)
    counted = matches if not rule.group else F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length)

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + x["pieces"]
        end = start + x["matches"]
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(rule_version(rule)).alias("rule"), F.lit(rule.kind).alias("kind"))
        found = F.when(x["counted"] >= rule.least, F.concat(done["found"], F.array(span))).otherwise(done["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    def walked(start: Column, some: Column) -> Column:
        return F.aggregate(some, F.struct(start.alias("at"), none.alias("found")), step)["found"]

    def in_parts(zipped: Column) -> Column:
        part = lambda k: F.slice(zipped, k * TOGETHER + 1, F.lit(TOGETHER))
        size = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x["pieces"] + x["matches"])
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(zipped) - 1) / TOGETHER).cast("int")), lambda k: F.struct(k.alias("k"), size(part(k)).alias("size")))
        placed = F.aggregate(
            parts,
            F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<k:int,at:int>>)").alias("list")),
            lambda a, p: F.struct((a["at"] + p["size"]).alias("at"), F.concat(a["list"], F.array(F.struct(p["k"].alias("k"), a["at"].alias("at")))).alias("list")),
        )
        return F.flatten(F.transform(placed["list"], lambda p: walked(p["at"], part(p["k"]))))

    zipped = F.arrays_zip(F.slice(pieces, 1, F.size(matches)).alias("pieces"), matches.alias("matches"), counted.alias("counted"))
    # as the only element of an array the matches are found once, and then named in the function
    spans = F.transform(F.array(zipped), lambda z: F.when(F.size(z) <= TOGETHER, walked(F.lit(0), z)).otherwise(in_parts(z)))[0]
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), spans).otherwise(none)


def scan(blobs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """blob, rules and the spans that these found; from (blob, text, missing), the rule versions to apply."""
    found = [F.when(F.array_contains("missing", rule_version(r)), spans_of(F.col("text"), r)).otherwise(F.expr(f"cast(array() as {SPANS})")) for r in rules]
    return blobs.select("blob", F.col("missing").alias("rules"), F.concat(*found).alias("spans"))


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def update_ledger(docs: DataFrame, ledger: str | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ledger after scanning the pairs of ``docs``' blobs and ``rules``' versions unseen so far.

    ``ledger`` is the path of the ledger table, new rows are appended there;
    without one the ledger starts empty, in the shared folder.
    """
    spark = docs.sparkSession
    path = ledger or new_table_path(spark, "secret-ledger")
    schema = f"blob string, rules array<string>, spans {SPANS}"
    versions = F.array(*[F.lit(rule_version(r)) for r in rules])
    held = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # one row stands for each blob: the one of the least id
    unseen = held.groupBy(blob_of(F.col("text")).alias("blob")).agg(F.min("doc_id").alias("holder")).withColumn("missing", versions)
    if ledger:
        spark.createDataFrame([], schema).write.mode("append").parquet(path)
        seen = spark.read.schema(schema).parquet(path).groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
        left = F.array_except("missing", F.coalesce("seen", F.expr("cast(array() as array<string>)")))
        unseen = unseen.join(seen, "blob", "left").select("blob", "holder", left.alias("missing")).filter(F.size("missing") > 0)
    unseen = written(unseen, "secret-unseen")
    keyed = held.select("doc_id", "text", blob_of(F.col("text")).alias("blob"))
    texts = keyed.join(unseen.withColumnRenamed("blob", "unseen"), F.col("doc_id").eqNullSafe(F.col("holder")) & (F.col("blob") == F.col("unseen")))
    found = scan(texts.select("blob", "text", "missing"), rules).dropDuplicates(["blob"])
    found.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def find_secrets(docs: DataFrame, ledger: str | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, blob and spans (null where there are none) of every row of ``docs``, by start and then by the order of the rules."""
    versions = F.array(*[F.lit(rule_version(r)) for r in rules])
    rank = lambda x: (F.array_position(versions, x["rule"]) - 1).cast("int")
    span = lambda x: F.struct(x["start"].alias("start"), rank(x).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))
    known = F.filter("spans", lambda x: F.array_contains(versions, x["rule"]))
    hits = update_ledger(docs, ledger, rules).filter(F.size("spans") > 0).select("blob", F.transform(known, span).alias("spans"))
    hits = hits.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans")).filter(F.size("spans") > 0)
    return docs.select("doc_id", blob_of(F.col("text")).alias("blob")).join(hits, "blob", "left")


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of each row's spans, as the query returns them."""
    n_base = len(BASE_RULES)
    spans = F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string>>)"))
    line = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter(spans, lambda x: x["rank"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{BASE_RULES[k].kind}") for k in range(n_base)],
        F.sha2(line(F.filter(spans, lambda x: x["rank"] < n_base)), 256).alias("base_sha256"),
        line(spans).alias("spans"),
    )


def masked(docs: DataFrame, found: DataFrame, mask: str = "*") -> DataFrame:
    """``docs`` with every span of its text overwritten, length kept; columns stay as they are."""
    hits = found.filter(F.col("spans").isNotNull()).select(F.col("blob").alias("_secret_blob"), F.col("spans").alias("_secret_spans")).dropDuplicates(["_secret_blob"])
    joined = docs.join(hits, blob_of(F.col("text")) == F.col("_secret_blob"), "left")

    def cover(text: Column, x: Column) -> Column:
        return F.overlay(text, F.repeat(F.lit(mask), x["end"] - x["start"]), x["start"] + 1)

    hidden = F.aggregate("_secret_spans", F.col("text"), cover)
    return joined.withColumn("text", F.coalesce(hidden, "text")).select(docs.columns)


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for k, r in enumerate(RULES):
        parts.append(
            f"SELECT doc_id, {k} AS rank, {quote(r.kind)} AS kind, {r.least} AS least, "
            f"string_split_regex(t, {quote(r.pattern)}) AS pieces, regexp_extract_all(t, {quote(r.pattern)}, 0) AS matches, "
            f"regexp_extract_all(t, {quote(r.pattern)}, {r.group}) AS counted FROM texts"
        )
    return (
        "WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), split AS (" + " UNION ALL ".join(parts) + "), "
        "numbered AS (SELECT doc_id, rank, kind, least, pieces, matches, counted, unnest(range(1, len(matches) + 1)) AS i FROM split), "
        "placed AS (SELECT doc_id, rank, kind, least, length(counted[i]) AS n, length(matches[i]) AS m, "
        "list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(matches[1:i-1], lambda x: length(x))), 0) AS s FROM numbered), "
        "hits AS (SELECT doc_id, rank, kind, CAST(s AS BIGINT) AS s, CAST(s + m AS BIGINT) AS e FROM placed WHERE n >= least), "
        "lines AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex, "
        "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3), '') AS base, "
        "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM hits GROUP BY doc_id) "
        "SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, "
        "sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN lines l ON d.doc_id = l.doc_id"
    )


ORACLE = _oracle()

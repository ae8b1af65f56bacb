"""The trie of conversation prefixes, as intervals of a preorder.

Turns stand for themselves by 16-byte digests, so a conversation is a string of digests. Spark sorts the
distinct ones, which ranks them lexicographically; a node of the trie, a prefix, then holds those of one interval
of ranks. Each task walks its stretch of the order with a stack and gives every node of it once; nodes that reach over
several tasks are merged by an aggregation. In the order of (first rank, depth) the nodes stand in *preorder*: a subtree is the
run from its top to the leaf of its last rank, its stored end. Prefix sums over the preorder, added up within tasks and then moved
by the sums of the tasks before, give leaves and savings of a subtree as the difference of two numbers.

Members of a node that end there are hashed in the order of their ids. A digest is one sequence by nature, so
range-sorted tasks first join ids to pieces of ``TOGETHER``, and the node's pieces then pass one hasher in a stream;
nothing of a node is gathered. Of a conversation one task holds the digests (24 bytes a turn), never the texts.

Defined results: rows without conv_id are left out; null roles and texts are empty; turns of one
number stand in the order of their digests; repeated rows are repeated turns; a conversation that is rebuilt without turns ends at
the root; an empty table has no node; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cotejo.llm._session import dropped, written

#: Conversations that take their first turns from one of them, and by how many turns at most.
FAMILY, MOST_SHARED = 5, 8
#: Ids in a piece.
TOGETHER = 512
DIGEST = 16
ROWS = 4096


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest (of role and text) and size (bytes of the text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    held = conversations.filter(F.col("conv_id").isNotNull())
    return held.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))


def rebuild(turns: DataFrame, family: int = FAMILY, most: int = MOST_SHARED) -> DataFrame:
    """conv_id, node (of the whole path), path (digests, one after another) and sizes of every conversation.

    Conversation c takes its first h turns from conversation c - c % ``family``, h = crc32(c) % (``most`` + 1).
    """
    base = F.col("conv_id") - F.col("conv_id") % family
    keyed = turns.withColumns({"base": base, "h": F.crc32(F.col("conv_id").cast("string")) % (most + 1), "own": base != F.col("conv_id")})
    dealt = keyed.repartition("base").sortWithinPartitions("base", "own", "conv_id", F.col("turn").asc_nulls_first(), "digest")

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: tuple[int | None, bytes, list[int]] = (None, b"", [])
        open_: tuple[int, int, int, bytearray, list[int]] | None = None
        rows: list[tuple] = []

        def close() -> None:
            nonlocal head
            base, conv, h, digests, sizes = open_
            if conv == base:
                head = base, bytes(digests[: most * DIGEST]), sizes[:most]
            first, first_sizes = (head[1], head[2]) if head[0] == base else (b"", [])
            path = first[: h * DIGEST] + bytes(digests[h * DIGEST :])
            rows.append((conv, hashlib.md5(path, usedforsecurity=False).digest(), path, first_sizes[:h] + sizes[h:]))

        def flush() -> pa.RecordBatch:
            kinds = pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())
            out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["conv_id", "node", "path", "sizes"])
            rows.clear()
            return out

        for batch in batches:
            bases, convs, hs, sizes = (batch.column(c).to_numpy() for c in ("base", "conv_id", "h", "size"))
            digests = b"".join(batch.column("digest").to_pylist())
            cuts = [0, *(np.flatnonzero(np.diff(convs)) + 1).tolist(), len(convs)] if len(convs) else [0]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if open_ is None or open_[1] != convs[lo]:
                    if open_ is not None:
                        close()
                    open_ = int(bases[lo]), int(convs[lo]), int(hs[lo]), bytearray(), []
                open_[3].extend(digests[lo * DIGEST : hi * DIGEST])
                open_[4].extend(sizes[lo:hi].tolist())
            if len(rows) >= ROWS:
                yield flush()
        if open_ is not None:
            close()
        yield flush()

    return dealt.select("base", "conv_id", "h", "digest", "size").mapInArrow(rebuilt, "conv_id long, node binary, path binary, sizes array<long>")


PARTIAL = "node binary, parent binary, depth long, size long, lo long, hi long, n_convs long, conv_id long, childless boolean"
_KINDS = [pa.binary(), pa.binary(), *[pa.int64()] * 6, pa.bool_()]
_NAMES = [c.split()[0] for c in PARTIAL.split(", ")]


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a sorted stretch of sequences (path, sizes, rank, n, conv_id), each once."""
    stack: list[list] = []  # node, turn, size, first rank, n, least conversation, childless
    rows: list[tuple] = []
    rank = -1

    def pop() -> None:
        node, _, size, lo, n, least, childless = stack.pop()
        if stack:
            top = stack[-1]
            top[4], top[5], top[6] = top[4] + n, min(top[5], least), False
        rows.append((node, stack[-1][0] if stack else None, len(stack), size, lo, rank, n, least, childless))

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_KINDS)], _NAMES)
        rows.clear()
        return out

    for batch in batches:
        for path, sizes, at, n, conv in zip(*(batch.column(c).to_pylist() for c in ("path", "sizes", "rank", "n", "least")), strict=True):
            turns = [path[k : k + DIGEST] for k in range(0, len(path), DIGEST)]
            shared = 0
            while shared < len(turns) and shared + 1 < len(stack) and stack[shared + 1][1] == turns[shared]:
                shared += 1
            while len(stack) > shared + 1:
                pop()
            hasher = hashlib.md5(path[: shared * DIGEST], usedforsecurity=False)
            if not stack:
                stack.append([hasher.digest(), b"", 0, at, 0, conv, True])
            for k in range(shared, len(turns)):
                hasher.update(turns[k])
                stack.append([hasher.digest(), turns[k], sizes[k], at, 0, conv, True])
            stack[-1][4] += n
            stack[-1][5] = min(stack[-1][5], conv)
            rank = at
            if len(rows) >= ROWS:
                yield flush()
    while stack:
        pop()
    yield flush()


def nodes_of(rebuilt: DataFrame) -> DataFrame:
    """The distinct nodes with the interval of ranks that each holds (lo, hi), n_convs and conv_id (the least member)."""
    sequences = rebuilt.groupBy("node").agg(F.first("path").alias("path"), F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("least"))
    # numbers of a sorted table grow with its order; they need not be without gaps
    ranked = sequences.drop("node").orderBy("path").withColumn("rank", F.monotonically_increasing_id())
    partial = ranked.mapInArrow(_walk, PARTIAL)
    merged = partial.groupBy("node").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("size").alias("size"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("childless").alias("childless"),
    )
    return merged.withColumn("saved", (F.col("n_convs") - 1) * F.col("size"))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds task, and place, leaves and saved counted from the task's first row on, itself included."""
    from pyspark import TaskContext

    task, done = TaskContext.get().partitionId(), np.zeros(3, np.int64)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        steps = np.stack([np.ones(n, np.int64), batch.column("childless").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("saved").to_numpy()])
        sums = steps.cumsum(axis=1) + done[:, None]
        done = sums[:, -1]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, task, np.int32)), *map(pa.array, sums)], [*batch.schema.names, "task", "place", "leaves_to", "saved_to"])


def preorder(nodes: DataFrame) -> DataFrame:
    """``nodes`` with place (from 1, in preorder) and the prefix sums leaves_to and saved_to, each row's own included."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
    sums = ["place", "leaves_to", "saved_to"]
    local = written(nodes.orderBy("lo", "depth").mapInArrow(_summed, f"{kinds}, task int, {', '.join(f'{c} long' for c in sums)}"), "trie-preorder")
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each task of the sort
    totals = local.groupBy("task").agg(F.max("place").alias("place"), F.max("leaves_to").alias("leaves_to"), F.max("saved_to").alias("saved_to"))
    offsets = totals.select("task", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in sums])
    return local.join(F.broadcast(offsets), "task").select(*nodes.columns, *[(F.col(c) + F.col(f"{c}_before")).alias(c) for c in sums])


def ends_of(rebuilt: DataFrame) -> DataFrame:
    """at (a node) and ends_sha256 of the ids, ascending, of the conversations that end there; only of nodes that have any."""
    ordered = rebuilt.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, ids = batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()
            rows, lo = [], 0
            for k in range(1, len(ids) + 1):
                if k == len(ids) or nodes[k] != nodes[lo] or k - lo == TOGETHER:
                    rows.append((nodes[lo], ids[lo], ",".join(map(str, ids[lo:k]))))
                    lo = k
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.string()))], ["at", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, hasher = None, hashlib.sha256()
        for batch in batches:
            rows = []
            for at, ids in zip(batch.column("at").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if at != open_:
                    if open_ is not None:
                        rows.append((open_, hasher.hexdigest()))
                    open_, hasher = at, hashlib.sha256(ids.encode())
                else:
                    hasher.update(f",{ids}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["at", "ends_sha256"])
        if open_ is not None:
            yield pa.RecordBatch.from_arrays([pa.array([open_], pa.binary()), pa.array([hasher.hexdigest()])], ["at", "ends_sha256"])

    pieces = ordered.mapInArrow(joined, "at binary, first long, ids string")
    return pieces.repartition("at").sortWithinPartitions("at", "first").select("at", "ids").mapInArrow(hashed, "at binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, family: int = FAMILY, most: int = MOST_SHARED) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations.

    node and parent (digests of the prefixes), conv_id (the least member), depth, parent_conv_id, n_convs, n_children,
    place and end (the subtree's interval of the preorder), n_leaves, saved_tokens and ends_sha256.
    """
    rebuilt = written(rebuild(turns_of(conversations), family, most), "trie-conversations")
    nodes = written(nodes_of(rebuilt), "trie-nodes")
    placed = written(preorder(nodes), "trie-places")
    dropped(nodes)
    last = placed.filter("childless").select(F.col("lo").alias("rank"), F.col("place").alias("end"), F.col("leaves_to").alias("leaves_end"), F.col("saved_to").alias("saved_end"))
    children = placed.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("of")).agg(F.count("*").alias("n_children"))
    above = placed.select(F.col("node").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    out = placed.join(last, F.col("hi") == F.col("rank")).join(children, F.col("node") == F.col("of"), "left").join(ends_of(rebuilt), F.col("node") == F.col("at"), "left")
    return out.join(above, F.col("parent") == F.col("above"), "left").select(
        "node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "place", "end",
        (F.col("leaves_end") - F.col("leaves_to") + F.col("childless").cast("long")).alias("n_leaves"),
        (F.col("saved_end") - F.col("saved_to") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


ORACLE = f"""
WITH turns AS (SELECT conv_id AS c, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS m, strlen(coalesce(text, '')) AS size, turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, m, size, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, m) AS k FROM turns),
convs AS (SELECT c, c - c % {FAMILY} AS base, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [CAST(0 AS BIGINT) for z in range(8)]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % {MOST_SHARED + 1} AS h
  FROM (SELECT DISTINCT c FROM own)),
rebuilt AS (SELECT convs.c, 0 AS part, k, m, size FROM convs JOIN own ON own.c = base AND k <= h
  UNION ALL SELECT convs.c, 1, k, m, size FROM convs JOIN own ON own.c = convs.c AND k > h),
paths AS MATERIALIZED (SELECT convs.c, coalesce(list(m ORDER BY part, k) FILTER (m IS NOT NULL), []) AS path, coalesce(list(size ORDER BY part, k) FILTER (m IS NOT NULL), []) AS sizes FROM convs LEFT JOIN rebuilt USING (c) GROUP BY convs.c),
members AS (SELECT c, path[1:d] AS prefix, d, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size, d = len(path) AS ends FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM paths)),
nodes AS MATERIALIZED (SELECT prefix, any_value(d) AS d, min(c) AS c, count(*) AS n, (count(*) - 1) * any_value(size) AS w, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '') AS ids FROM members GROUP BY prefix),
children AS (SELECT prefix[1:d - 1] AS prefix, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
below AS (SELECT a AS prefix, sum(w) AS saved, count(*) FILTER (leaf) AS leaves
  FROM (SELECT prefix[1:e] AS a, w, leaf FROM (SELECT nodes.prefix, w, children.n IS NULL AS leaf, unnest(range(0, d + 1)) AS e FROM nodes LEFT JOIN children USING (prefix))) GROUP BY a)
SELECT nodes.c AS conv_id, d AS depth, parents.c AS parent_conv_id, nodes.n AS n_convs, coalesce(children.n, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(nodes.ids) AS ends_sha256
FROM nodes JOIN below USING (prefix) LEFT JOIN children USING (prefix) LEFT JOIN (SELECT prefix AS above, c FROM nodes) parents ON d > 0 AND above = nodes.prefix[1:d - 1]
"""

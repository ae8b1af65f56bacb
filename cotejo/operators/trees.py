"""Tree similarity of programs without a parser: statements and blocks as a tree, and its pq-gram profile.

A statement begins after ``{``, ``}`` or a ``;`` outside parentheses, and is named by its first token: a keyword as it is, any
other name ``ID``, so renamed copies agree. A block's statements hang below the statement that its brace follows; a bare block is a node
of its own. Below a root stands what has no block around it.

A pq-gram is a node with its parent and ``Q`` neighbours among its children, with ``*`` where there is none. The distance of two profiles
(1 less twice what they share over what both hold) is 0 for equal trees; times the number of pq-grams of both it is a lower bound of
the fanout-weighted edit distance of the trees, which needs no search for the best edits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotejo.functions.style import runs
from cotejo.functions.text import KEYWORDS, without_comments
from cotejo.operators.flow import _TOKEN
from cotejo.sources.scratch import kept

#: Children in a pq-gram; of ancestors there is the parent.
Q = 3
ROOT, NONE = "#", "*"


def _label(token: Column) -> Column:
    return F.when(token.rlike(r"^[A-Za-z_]\w*$") & ~token.isin(*KEYWORDS), F.lit("ID")).otherwise(token)


def nodes(code: DataFrame, key: str, text: str = "contenido") -> DataFrame:
    """key, pos, padre and etiqueta of every node: pos is the place of its first token, -1 the root's, whose parent is null."""
    found = code.select(key, F.posexplode(F.regexp_extract_all(without_comments(F.col(text)), F.lit(_TOKEN), F.lit(0))).alias("pos", "token"))
    line = Window.partitionBy(key).orderBy("pos")
    count = lambda c: F.count_if(F.col("token") == c).over(line)
    around = found.select(key, "pos", "token", (count("(") - count(")")).alias("inside"), (count("{") - count("}")).alias("depth"))
    ends = F.col("token").isin("{", "}") | (F.col("token") == ";") & (F.col("inside") <= 0)
    marked = around.withColumn("ends", ends).withColumn("fresh", F.coalesce(F.lag("ends").over(line), F.lit(True)))
    starts = marked.filter("fresh and (not ends or token = '{')")
    # the brace of a bare block counts itself already
    level = F.greatest(F.col("depth") - (F.col("token") == "{").cast("int"), F.lit(0))
    own = starts.select(key, "pos", _label(F.col("token")).alias("etiqueta"), level.alias("level"))
    # a node asks, on the level above, for the last node before it
    asked = own.select(key, "pos", "etiqueta", (F.col("level") - 1).alias("level"), F.lit(None).cast("int").alias("place")).unionByName(own.select(key, "pos", F.lit(None).cast("string").alias("etiqueta"), "level", F.col("pos").alias("place")))
    above = F.last("place", ignorenulls=True).over(Window.partitionBy(key, "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    hung = asked.withColumn("padre", F.coalesce(above, F.lit(-1))).filter("etiqueta is not null").select(key, "pos", "padre", "etiqueta")
    roots = code.filter(F.col(text).isNotNull()).select(key, F.lit(-1).alias("pos"), F.lit(None).cast("int").alias("padre"), F.lit(ROOT).alias("etiqueta"))
    return hung.unionByName(roots)


def profile(code: DataFrame, key: str, text: str = "contenido", q: int = Q) -> DataFrame:
    """key, gram and n: how often each pq-gram occurs in a program's tree."""
    tree = kept(nodes(code, key, text), "tree-nodes")
    children = tree.filter("padre is not null").groupBy(key, F.col("padre").alias("pos")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "etiqueta"))), lambda x: x["etiqueta"]).alias("hijos"))
    parents = tree.select(key, F.col("pos").alias("padre"), F.col("etiqueta").alias("arriba"))
    whole = tree.join(children, [key, "pos"], "left").join(parents, [key, "padre"], "left")
    blank = F.array_repeat(F.lit(NONE), q - 1)
    windows = F.when(F.col("hijos").isNull(), F.array(F.array_join(F.array_repeat(F.lit(NONE), q), " "))).otherwise(runs(F.concat(blank, "hijos", blank), q, lambda xs: F.concat_ws(" ", *xs)))
    grams = whole.select(key, F.concat_ws(" ", F.coalesce("arriba", F.lit(NONE)), "etiqueta").alias("stem"), F.explode(windows).alias("base"))
    return grams.select(key, F.concat_ws(" | ", "stem", "base").alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("n"))


def tree_classes(profiles: DataFrame, key: str) -> DataFrame:
    """key and clase, the least key with the same profile."""
    whole = profiles.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "gram", "n"))), ","), 256).alias("digest"))
    return whole.select(key, F.min(key).over(Window.partitionBy("digest")).alias("clase"))


def tree_distances(profiles: DataFrame, classes: DataFrame, key: str, most: float = 1.0) -> DataFrame:
    """a, b (classes, a < b), distancia and cota, the bound of the edit distance, of all pairs of classes that share a gram and are ``most`` apart at most."""
    own = profiles.join(classes.filter(F.col(key) == F.col("clase")).select(key), key, "left_semi")
    sized = own.join(own.groupBy(key).agg(F.sum("n").alias("size")), key)
    side = lambda a, n, m: sized.select("gram", F.col(key).alias(a), F.col("n").alias(n), F.col("size").alias(m))
    shared = side("a", "n", "na").join(side("b", "m", "nb"), "gram").filter("a < b").groupBy("a", "b").agg(F.sum(F.least("n", "m")).alias("s"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    both = F.col("na") + F.col("nb")
    return shared.select("a", "b", F.round(1 - 2 * F.col("s") / both, 6).alias("distancia"), (both - 2 * F.col("s")).alias("cota")).filter(F.col("distancia") <= most)

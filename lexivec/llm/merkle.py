"""Merkle manifest of a table: a hash tree over its rows, and for every row the climb from leaf to root.

A row is a leaf, the hash of its fields. The leaves of one source, in the order of their ids, are hashed
three at a time until one is left, its subroot; the subroots, in the order of their sources, likewise give
the root.

1. Rows become leaves in one pass; `tampered` is the leaf of the changed row. Leaves are numbered per source
   by `rank_all`, so a source of any size spreads over many tasks.
2. Levels are built bottom up, `stride` of them with one shuffle: a page holds the up to 3^stride nodes below
   one node `stride` levels higher. Each node of a page becomes a stored row: its siblings on the way up to
   the parent of the page, and the number of that parent, the node of the next stored level.
3. A recursive query climbs: every leaf starts with its own row, and each step joins the row of the parent,
   appends its siblings and folds the tampered hash. With `stride=1` a step is a single level; larger
   strides join the same siblings in fewer steps, since what a climb carries is written once a step.
4. Every node above the first stored level is an ancestor of many leaves. Its row is stored once for each
   page of leaves below it, so that a step joins at most 3^stride leaves with one row, whatever the size of
   a source; that adds the number of pages times the number of steps.

Defined cases: a field is `-` if null, else its length in bytes, a colon and its value. Rows without a source
are a source of their own, before all others. Rows without an id come first within their source and are never
tampered; equal ids are ordered by leaf. Rows that repeat are leaves of their own. A single leaf is its own
subroot, a single subroot the root; the siblings of such a leaf are none. An empty table has no rows. Columns
other than `fields` play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.llm.shared import saved
from lexivec.scale import is_small, rank_all

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes hashed together.
RUN = 3
#: Levels that one stored row climbs.
STRIDE = 5
#: Stands for the levels above the subroots, as a source number.
TOP = -1

CLIMB = """
WITH RECURSIVE climb(tree, page, place, step, doc_id, leaf, folded, siblings) AS (
  SELECT tree, page, place, step, doc_id, leaf, folded, siblings FROM {leaves}
  UNION ALL
  SELECT c.tree, c.page, c.place, n.next, c.doc_id, c.leaf,
         aggregate(n.path, c.folded, (h, x) -> unhex(sha2(concat(lower(hex(x.before)), lower(hex(h)), lower(hex(x.after))), 256))),
         concat(c.siblings, aggregate(n.path, CAST('' AS BINARY), (s, x) -> concat(s, x.before, x.after)))
  FROM climb c JOIN {nodes} n ON c.tree = n.tree AND c.page = n.page AND c.step = n.step
)
SELECT tree, page, place, doc_id, leaf, folded, siblings FROM climb WHERE step IS NULL
"""


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts as hexadecimal text, as bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def shown(hash_: Column) -> Column:
    return F.lower(F.hex(hash_))


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(columns: dict[str, Column]) -> Column:
    return digest(*(field(c) for c in columns.values()))


def _levels_above(n: Column) -> Column:
    """How many times n nodes are hashed by threes until one is left."""
    powers = [RUN**k for k in range(40)]  # 3^39 is the last below 2^63
    return sum((F.when(n > p, 1).otherwise(0) for p in powers), F.lit(0))


def _pages(nodes: DataFrame, sizes: DataFrame, stride: int) -> DataFrame:
    """tree, page, levels (from the nodes of a page up to its parent), the numbers of nodes on each level.

    `nodes(tree, place, hash, ...)`, `sizes(tree, n)`. The last page of a tree, its only one, ends with one node.
    """
    side = RUN**stride
    sizes = F.broadcast(sizes) if is_small(sizes) else sizes
    whole = nodes.join(sizes, "tree").withColumn("page", F.floor(F.col("place") / side))
    own = [c for c in nodes.columns if c != "tree"]
    height = F.when(F.col("n") > side, F.lit(stride)).otherwise(_levels_above(F.col("n")))
    paged = whole.groupBy("tree", "page").agg(
        F.array_sort(F.collect_list(F.struct(*own))).alias("nodes"), F.first(height).alias("height"), F.first("n").alias("n")
    )
    paged = paged.withColumn("level_0", F.col("nodes")["hash"])
    for k in range(1, stride + 1):
        below = F.col(f"level_{k - 1}")
        paged = paged.withColumn(f"level_{k}", F.when(F.col("height") >= k, _level_above(below)).otherwise(below))
    return paged


def _level_above(below: Column) -> Column:
    """The hashes of every `RUN` consecutive nodes; the last run may be shorter."""

    def parent(run: Column) -> Column:
        return digest(F.array_join(F.transform(F.slice(below, RUN * run + 1, RUN), shown), ""))

    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(below) / RUN).cast("int") - 1), parent)


def _path(stride: int) -> Column:
    """The siblings of node `at` of a page, level by level: those before and those after it."""
    steps = []
    for k in range(stride):
        level, run = F.col(f"level_{k}"), F.floor(F.col("at") / RUN ** (k + 1)).cast("int")
        own = F.floor(F.col("at") / RUN**k).cast("int") - RUN * run
        none = F.lit(b"")
        joined = lambda part: F.aggregate(part, F.lit(b""), lambda s, h: F.concat(s, h))
        before = F.when(own > 0, joined(F.slice(level, RUN * run + 1, own))).otherwise(none)
        after = joined(F.slice(level, RUN * run + own + 2, RUN - 1 - own))
        steps.append(F.struct(before.alias("before"), after.alias("after")))
    return F.slice(F.array(*steps), F.lit(1), F.col("height"))


def _climbable(paged: DataFrame, stride: int, *more: str) -> DataFrame:
    """One row per node of the pages: tree, place, path, last (whether its parent is the top of the tree)."""
    return paged.select(
        "tree", F.posexplode("nodes").alias("at", "node"), "height", *(f"level_{k}" for k in range(stride)),
        (F.col("n") <= RUN**stride).alias("last"),
    ).select("tree", F.col("node.place").alias("place"), "last", _path(stride).alias("path"), *(f"node.{c}" for c in more))


def _parents(paged: DataFrame, stride: int) -> DataFrame:
    """The parents of the pages, which are the nodes of the next stored level."""
    return paged.select("tree", F.col("page").alias("place"), F.get(f"level_{stride}", F.lit(0)).alias("hash"))


def _tree(nodes: DataFrame, stride: int, label: str, *more: str) -> tuple[list[DataFrame], DataFrame]:
    """The stored levels of all trees of `nodes(tree, place, hash, ...)`, and the last node of each: tree, hash, n (leaves)."""
    side, levels, tops = RUN**stride, [], []
    sizes = saved(nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), f"{label}-sizes")
    leaves = sizes
    while True:
        paged = saved(_pages(nodes, sizes, stride), f"{label}-pages")
        levels.append(_climbable(paged, stride, *(more if not levels else ())))
        tops.append(_parents(paged.filter(F.col("n") <= side), stride).drop("place"))
        sizes = sizes.filter(F.col("n") > side).withColumn("n", F.ceil(F.col("n") / side))
        if sizes.isEmpty():
            break
        nodes = _parents(paged.filter(F.col("n") > side), stride)
    found = tops[0]
    for top in tops[1:]:
        found = found.union(top)
    return levels, saved(found.join(leaves, "tree"), f"{label}-tops")


def manifest(
    table: DataFrame, tampered: dict[str, Column] | None = None, fields: Sequence[str] = FIELDS, doc_id: str = "doc_id",
    source: str = "source", stride: int = STRIDE,
) -> DataFrame:
    """One row per row of `table`: doc_id, source, place, leaf, subroot, root, siblings (bytes), folded_root.

    `tampered` gives the changed value of fields; the folded root is computed from the leaf of the changed row and
    the siblings as they were. All hashes but `siblings` are hexadecimal text.
    """
    spark = table.sparkSession
    side = RUN**stride
    plain = {c: F.col(c) for c in fields}
    leaves = table.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        leaf_of(plain).alias("hash"),
        leaf_of({**plain, **(tampered or {})}).alias("tampered"),
    )
    leaves = saved(leaves, "leaves")
    ordered = rank_all(leaves.select("source").distinct(), [], [F.col("source").asc_nulls_first()], "tree")
    numbers = saved(ordered.select("source", (F.col("tree") - 1).alias("tree")), "sources")
    known = F.broadcast(numbers) if is_small(numbers) else numbers
    named = leaves.alias("l").join(known.alias("s"), F.col("l.source").eqNullSafe(F.col("s.source"))).select("l.doc_id", "s.tree", "hash", "tampered")
    ranked = rank_all(named, ["tree"], [F.col("doc_id").asc_nulls_first(), F.col("hash").asc(), F.col("tampered").asc()], "place")
    numbered = ranked.withColumn("place", F.col("place") - 1).select("tree", "place", "hash", "doc_id", "tampered")
    levels, tops = _tree(numbered, stride, "rows", "hash", "doc_id", "tampered")
    upper, root = _tree(tops.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("place"), "hash"), stride, "sources")

    # The way of each page of leaves: the nodes above its first parent, in order, first those of its own source.
    pages = tops.select("tree", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / side))).alias("page"))
    way = []
    for k, level in enumerate(levels[1:]):
        here = pages.withColumn("place", F.floor(F.col("page") / side**k))
        way.append(here.join(level, ["tree", "place"]).select("tree", "page", F.lit(k + 1).alias("step"), "path", F.lit(False).alias("top"), "last"))
    for k, level in enumerate(upper):
        here = pages.withColumn("place", F.floor(F.col("tree") / side**k))
        level = level.select("place", "path", "last")
        level = F.broadcast(level) if is_small(level) else level
        way.append(here.join(level, "place").select("tree", "page", F.lit(len(levels) + k).alias("step"), "path", F.lit(True).alias("top"), "last"))
    nodes = way[0]
    for part in way[1:]:
        nodes = nodes.union(part)
    # A step is followed by the next one, the last of a source by the first above the subroots.
    following = F.when(~F.col("last"), F.col("step") + 1).when(~F.col("top"), F.lit(len(levels)))
    nodes = saved(nodes.select("tree", "page", "step", following.cast("int").alias("next"), "path"), "nodes")
    hashed = F.aggregate("path", F.col("tampered"), lambda h, x: digest(shown(x["before"]), shown(h), shown(x["after"])))
    met = F.aggregate("path", F.lit(b""), lambda s, x: F.concat(s, x["before"], x["after"]))
    first = F.when(F.col("last"), F.lit(len(levels))).otherwise(F.lit(1))
    start = levels[0].select(
        "tree", F.floor(F.col("place") / side).alias("page"), "place", first.alias("step"), "doc_id", F.col("hash").alias("leaf"),
        hashed.alias("folded"), met.alias("siblings"),
    )
    climbed = _climbed(spark, start, nodes)
    top = root.select("hash").scalar()
    subroots = pages.join(tops.select("tree", F.col("hash").alias("subroot")), "tree").select("tree", "page", "subroot")
    names = F.broadcast(numbers) if is_small(numbers) else numbers
    return climbed.join(subroots, ["tree", "page"]).join(names, "tree").select(
        "doc_id", "source", "place", shown(F.col("leaf")).alias("leaf"), shown(F.col("subroot")).alias("subroot"),
        shown(top).alias("root"), "siblings", shown(F.col("folded")).alias("folded_root"),
    )


def _climbed(spark, start: DataFrame, nodes: DataFrame) -> DataFrame:
    """The end of every climb, written once: the recursive query has no limit on its rows while it runs."""
    limits = {"spark.sql.cteRecursionRowLimit": "-1", "spark.sql.cteRecursionLevelLimit": "100"}
    before = {name: spark.conf.get(name, None) for name in limits}
    try:
        for name, value in limits.items():
            spark.conf.set(name, value)
        return saved(spark.sql(CLIMB, leaves=start, nodes=nodes), "climbed")
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)

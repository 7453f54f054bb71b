"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

A node of depth d is a distinct sequence of d turns (role and text) with which some conversation begins; its
members are the conversations that do. A node is known by its smallest member and its depth.

1. Turns are numbered by `rank_all`, so a conversation of any length spreads over many tasks. Every place adds a
   128-bit hash of place, role and text, and the hash of a prefix is the sum up to its end: sums of parts of a
   conversation add up, so they need no task that sees it whole. Prefixes of equal depth and sum are one node.
2. Nodes are grouped with partial aggregation. A row finds its node by a join in which the rows of a node are
   dealt over up to 1024 parts, so that a first turn that a third of all conversations share is split.
3. Rake and compress: in each round all leaves leave the tree and add their totals to their parents; then, of
   each chain of nodes with a single child, every node that goes before its neighbours in a fixed order (trailing
   zeros of the depth, then depth) is taken out, its child linked to its parent, its own weight kept on that link.
   A chain halves in each round, so rounds grow with the logarithm of the tree. Each is written to the work folder.
4. The rounds are undone last to first: the total of a node that was taken out is that of its child, which was
   in the tree longer, and the weight between them. What a round looks up is no larger than the tree it left.

Defined cases: rows without a conversation are left out; a null turn comes first, a null role or text is empty,
equal turns are ordered by role and text, repeated rows are turns of their own. A conversation without turns is a
member of the root alone. Without conversations there is no node, not even a root. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexivec.llm.shared import looked_up, saved, words
from lexivec.scale import rank_all

#: Places of a conversation that are summed in one group.
SLICE = 4096
#: Conversation ids that are written as one text before they are hashed.
IDS = 1024
NODE = ["conv_id", "depth"]
KEY = ["depth", "sum_a", "sum_b"]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), role, text: the turns of every conversation in order."""
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    return rank_all(turns, ["conv_id"], order, "place").select("conv_id", "place", "role", "text")


def regrafted(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another one: the first h turns of conversation `c - c % every`, then those
    of c itself after its own first h, where h is the CRC-32 of the decimal c modulo `most`.

    Returns the turns (conv_id, place, role, text) and all conversations (conv_id).
    """
    conversations = turns.select("conv_id").distinct()
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    plan = conversations.select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), taken.alias("h"))
    heads = turns.filter(F.col("place") < most).select(F.col("conv_id").alias("base"), "place", "role", "text")
    lengths = heads.groupBy("base").agg(F.count(F.lit(1)).alias("n"))
    planned = saved(plan.join(lengths, "base", "left").withColumn("given", F.least("h", F.coalesce("n", F.lit(0)))), "plan")
    begun = planned.join(heads, "base").filter(F.col("place") <= F.col("h")).select("conv_id", "place", "role", "text")
    shift = F.col("given") - F.col("h")
    # The plan has one row a conversation; a long conversation is the skewed side, which Spark splits.
    own = turns.join(planned.select("conv_id", "h", "given"), "conv_id").filter(F.col("place") > F.col("h"))
    return begun.union(own.select("conv_id", (F.col("place") + shift).alias("place"), "role", "text")), conversations


def _prefixes(turns: DataFrame) -> DataFrame:
    """One row per turn: conv_id, the key of its prefix and that of the one before, words of its text, last or not."""
    own = turns.select(
        "conv_id", F.col("place").alias("depth"), F.size(words(F.col("text"))).cast("long").alias("words"),
        F.xxhash64("place", "role", "text").alias("a"), F.xxhash64(F.lit("second"), "text", "role", "place").alias("b"),
    ).withColumn("slice", F.floor(F.col("depth") / SLICE))
    own = saved(own, "turns")
    # Whole numbers of any size: a sum of longs could overflow, a decimal of 30 digits holds 10^10 of them.
    wide = {c: F.col(c).cast("decimal(20,0)") for c in "ab"}
    slices = own.groupBy("conv_id", "slice").agg(*(F.sum(v).alias(f"of_{c}") for c, v in wide.items()), F.max("depth").alias("end"))
    before = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(
        "conv_id", "slice", *(F.coalesce(F.sum(f"of_{c}").over(before), F.lit(0)).alias(f"before_{c}") for c in "ab"),
        F.max("end").over(Window.partitionBy("conv_id")).alias("length"),
    )
    within = Window.partitionBy("conv_id", "slice").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    summed = own.select("conv_id", "slice", "depth", "words", *(v.alias(c) for c, v in wide.items()), *(F.sum(v).over(within).alias(f"to_{c}") for c, v in wide.items()))
    ends = {c: (F.col(f"before_{c}") + F.col(f"to_{c}")).cast("decimal(38,0)") for c in "ab"}
    return summed.join(offsets, ["conv_id", "slice"]).select(
        "conv_id", "depth", *(v.alias(f"sum_{c}") for c, v in ends.items()),
        *((v - F.col(c)).cast("decimal(38,0)").alias(f"up_{c}") for c, v in ends.items()),
        "words", (F.col("depth") == F.col("length")).alias("last"),
    )


def _ends_hash(ends: DataFrame) -> DataFrame:
    """node columns and ends_sha256: the hash of the ids that end at a node, in order, read as a stream.

    Ids are first joined to texts of `IDS` neighbours. SHA-256 reads its text in one piece, so the texts of
    one node are read one after the other by one task, which holds only one of them.
    """
    near = F.floor(F.col("member") / IDS).alias("block")
    ids = F.transform(F.array_sort(F.collect_list("member")), lambda i: i.cast("string"))
    blocks = ends.groupBy(*NODE, near).agg(F.array_join(ids, ",").alias("ids"))
    blocks = blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block").select(*NODE, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            found = []
            for own in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if own[:2] == node:
                    state.update(b"," + own[2].encode())
                    continue
                if node is not None:
                    found.append((*node, state.hexdigest()))
                node, state = own[:2], hashlib.sha256(own[2].encode())
            yield _batch(found)
        if node is not None:
            yield _batch([(*node, state.hexdigest())])

    return blocks.mapInArrow(run, "conv_id long, depth long, ends_sha256 string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((), (), ())
    types = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*NODE, "ends_sha256"])


WEIGHTS = ("leaves", "tokens")


def _each(form: str) -> list[Column]:
    """The same expression for both weights."""
    return [F.expr(form.replace("#", w)) for w in WEIGHTS]


def _raked(live: DataFrame) -> DataFrame:
    """The tree without its leaves, whose totals and what lies on their links are added to their parents."""
    given = live.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(
        *_each("sum(if(n = 0, # + on_#, 0)) AS more_#"), F.expr("count_if(n > 0) AS left"), F.expr("min(if(n > 0, node, NULL)) AS child")
    )
    return live.filter("n > 0").join(given, "node").select(
        "node", "parent", F.col("left").alias("n"), F.expr("if(left = 1, child, NULL) AS child"), *_each("# + more_# AS #"), *_each("on_#")
    )


def _before(node: str, other: str) -> Column:
    """Whether a node goes before its neighbour in a chain: by trailing zeros of the depth, then depth."""

    def place(name: str) -> Column:
        depth = F.col(name)["depth"]
        return F.struct(F.bit_count(depth.bitwiseAND(-depth) - 1), depth)

    return F.col(other).isNull() | (place(node) < place(other))


def _compressed(tree: DataFrame) -> DataFrame:
    """The tree with no two neighbours of a chain taken out: `gone` names the node that went above a row, `add_...` the
    weight between the row's total and that of the node that went."""
    chain = tree.filter("n = 1 AND parent IS NOT NULL").select("node", "parent", "child", *_each("#"), *_each("on_#"))
    above = chain.select(F.col("node").alias("upper"), F.col("child").alias("node"))
    below = chain.select(F.col("node").alias("child"), F.col("node").alias("lower"))
    out = chain.join(above, "node", "left").join(below, "child", "left").filter(_before("node", "upper") & _before("node", "lower"))
    out = saved(out.select("child", "node", "parent", *_each("#"), *_each("on_#")), "out")
    link = out.select(F.col("child").alias("node"), F.col("node").alias("gone"), F.col("parent").alias("above"), *_each("# AS w_#"), *_each("on_# AS won_#"))
    stays = tree.drop("child").join(out.select("node"), "node", "left_anti").join(link, "node", "left")
    return stays.select(
        "node", F.expr("if(gone IS NULL, parent, above) AS parent"), "n", *_each("#"), *_each("on_# + coalesce(w_# + won_#, 0) AS on_#"),
        "gone", *_each("w_# + on_# AS add_#"),
    )


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """`node` and the totals of `leaves` and `tokens` over its subtree, by rounds of rake and compress.

    `nodes(node, parent, n, leaves, tokens)`: node and parent are structs with a field `depth` (that of a parent is
    smaller), the parent of a root is null, n is the number of children, leaves and tokens are the own weights.
    """
    live = saved(nodes.select("node", "parent", "n", *_each("#"), *_each("0L AS on_#")), "live")
    rounds = []
    while not live.isEmpty():
        tree = saved(_raked(live), "raked")
        after = saved(_compressed(tree), "live")
        rounds.append((live.filter("n = 0").select("node", *_each("#")), after))
        live = after.drop("gone", "add_leaves", "add_tokens")
    totals = None
    for leaves, after in reversed(rounds):
        if totals is None:  # the last round only rakes
            totals = leaves
            continue
        gone = after.filter("gone IS NOT NULL").select("node", "gone", *_each("add_#"))
        back = gone.join(totals, "node").select(F.col("gone").alias("node"), *_each("# + add_# AS #"))
        totals = totals.union(saved(back, "totals")).union(leaves)
    return live.select("node", *_each("#")) if totals is None else totals


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `turns(conv_id, place, role, text)` with places from 1 without gaps, `conversations(conv_id)` all of them.
    """
    rows = saved(_prefixes(turns), "prefixes")
    grouped = rows.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"),
        F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"),
    )
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    whole = [F.lit(0).cast("decimal(38,0)").alias(c) for c in ("sum_a", "sum_b")]
    none = [F.lit(None).cast("decimal(38,0)").alias(c) for c in ("up_a", "up_b")]
    top = root.select(F.lit(0).cast("long").alias("depth"), *whole, "conv_id", "n_convs", F.lit(0).cast("long").alias("words"), *none)
    nodes = saved(grouped.union(top), "nodes")
    up = [(F.col("depth") - 1).alias("depth"), F.col("up_a").alias("sum_a"), F.col("up_b").alias("sum_b")]
    children = nodes.filter("depth > 0").select(*up, "conv_id")
    counts = children.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"))
    names = nodes.select(*KEY, F.col("conv_id").alias("parent_conv_id"))
    parents = looked_up(children, KEY, names, "conv_id").select("conv_id", (F.col("depth") + 1).alias("depth"), "parent_conv_id")
    linked = nodes.join(counts, KEY, "left").join(parents, NODE, "left").select(
        *NODE, "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("own_tokens"),
    )
    linked = saved(linked, "linked")
    node = F.struct("conv_id", "depth")
    parent = F.struct(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    weighted = linked.select(
        node.alias("node"), F.when(F.col("depth") > 0, parent).alias("parent"), F.col("n_children").alias("n"),
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), F.col("own_tokens").alias("tokens"),
    )
    totals = subtree_totals(weighted).select("node.*", F.col("leaves").alias("n_leaves"), F.col("tokens").alias("saved_tokens"))
    last = rows.filter("last").select(*KEY, F.col("conv_id").alias("member"))
    named = nodes.select(*KEY, "conv_id")
    ends = looked_up(last, KEY, named, "member").select(*NODE, "member")
    turnless = conversations.join(turns.select("conv_id").distinct(), "conv_id", "left_anti").select(F.col("conv_id").alias("member"))
    at_root = turnless.select(root.select("conv_id").scalar().alias("conv_id"), F.lit(0).cast("long").alias("depth"), "member")
    hashes = _ends_hash(ends.union(at_root))
    return (
        linked.drop("own_tokens")
        .join(totals, NODE)
        .join(hashes, NODE, "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    )

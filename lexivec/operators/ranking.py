"""Work on ranked hits: records, pages, side-by-side comparison and reordering of the head."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.functions.collections import last_value
from lexivec.functions.scores import SIDE_BY_SIDE_SIM_LIMIT, low_confidence
from lexivec.scale import BROADCAST_ROWS, is_small, materialise, partition_count, top_per_group

# Rows of a page, and the number of first hits that are reordered.
PAGE = 10
HEAD = 20

# Copies of one row that a task writes out in a keyed shuffle.
COPIES = 1 << 16
TIMESTAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def attach_records(
    hits: DataFrame, records: DataFrame, key: str = "doc_id", how: str = "inner", most: int | None = None
) -> DataFrame:
    """Add the record of each hit.

    `most` is a known bound on the number of hits. Under the broadcast limit the
    hits go to the records, which then need no shuffle.
    """
    if how == "inner" and most is not None and most <= BROADCAST_ROWS:
        hits = F.broadcast(hits)
    return hits.join(records, key, how)


def page(ranked: DataFrame, shown: int = 0, size: int = PAGE, rank: str = "rank") -> DataFrame:
    """The next `size` hits of each query after the first `shown`."""
    return ranked.filter((F.col(rank) > shown) & (F.col(rank) <= shown + size))


def page_of_one(ranked: DataFrame, order: Sequence[Column], shown: int = 0, size: int = PAGE) -> DataFrame:
    """The next `size` hits of a single query's result."""
    return ranked.orderBy(*order).offset(shown).limit(size)


def side_by_side(semantic: DataFrame, lexical: DataFrame, sim_limit: float = SIDE_BY_SIDE_SIM_LIMIT) -> DataFrame:
    """Semantic hit i beside lexical hit i of the same query.

    Both sides are `(query_id, rank, id, score)`. `lexical_found` is false where
    the lexical result is shorter; `semantic_low` marks a similarity under the limit.
    """
    left = semantic.select(
        "query_id", "rank", F.col("id").alias("semantic_id"), F.col("score").alias("semantic_score")
    )
    right = lexical.select(
        "query_id", "rank", F.col("id").alias("lexical_id"), F.col("score").alias("lexical_score")
    )
    joined = left.join(right, ["query_id", "rank"], "left").withColumn("lexical_found", F.col("lexical_id").isNotNull())
    return joined.withColumn("semantic_low", low_confidence(F.col("semantic_score"), sim_limit=sim_limit))


def with_both_records(compared: DataFrame, records: DataFrame, key: str = "id") -> DataFrame:
    """Add the records of both hits of a side-by-side row, as `semantic_...` and `lexical_...` columns."""
    for side in ("semantic", "lexical"):
        named = records.select(*(F.col(c).alias(f"{side}_id" if c == key else f"{side}_{c}") for c in records.columns))
        compared = compared.join(named, f"{side}_id", "left")
    return compared


def head_order(field: str, head: int = HEAD, rank: str = "rank") -> list[Column]:
    """Sort order that puts the first `head` hits by a field, null as 0, and leaves the rest in place."""
    in_head = F.col(rank) <= head
    by_field = F.when(in_head, F.coalesce(F.col(field), F.lit(0.0)))
    return [(~in_head).asc(), by_field.desc(), F.col(rank).asc()]


def head_sort(
    ranked: DataFrame, field: str, head: int = HEAD, rank: str = "rank", new_rank: str = "new_rank"
) -> DataFrame:
    """Reorder the first `head` hits of each query by a stored score; hits after them keep their rank.

    Only the heads are shuffled.
    """
    first = top_per_group(
        ranked.filter(F.col(rank) <= head),
        ["query_id"],
        [F.coalesce(F.col(field), F.lit(0.0)).desc(), F.col(rank).asc()],
        head,
        new_rank,
    )
    rest = ranked.filter(F.col(rank) > head).withColumn(new_rank, F.col(rank))
    return splice(first, rest)


def splice(head: DataFrame, tail: DataFrame) -> DataFrame:
    """A reordered head in front of an untouched tail; columns that one side lacks are null there."""
    return head.unionByName(tail, allowMissingColumns=True)


def enrich(hits: DataFrame, metadata: DataFrame, name: str = "Longdefinition", key: str = "code") -> DataFrame:
    """Add the description found in a metadata table `(code, metatype)` of `{id, value}` lists; the last value wins."""
    described = metadata.select(key, last_value(F.col("metatype"), F.lit(name)).alias("description"))
    return hits.join(described, key, "left")


def result_counts(hits: DataFrame, queries: DataFrame, group: Sequence[str] = ("query_id",)) -> DataFrame:
    """Number of hits of each query, 0 for a query without any."""
    counts = hits.groupBy(*group).agg(F.count(F.lit(1)).alias("hits"))
    asked = queries.select(*group).distinct()
    return asked.join(counts, list(group), "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))


def shuffle_rows(df: DataFrame, seed: int | None = None) -> DataFrame:
    """Rows in random order."""
    return df.orderBy(F.rand(seed))


def shuffle_keyed(df: DataFrame, seed: int, place: str = "place", copies: int = COPIES) -> DataFrame:
    """Rows in an order that follows from the seed and the rows alone: `place` numbers them from 0 without gaps.

    The order is that of a hash of seed and row, the same however the table is cut
    into files. Hashes are spread evenly, so buckets of them are known in advance:
    no sample, no sort of the whole table, and a place is the rows of the earlier
    buckets and those before it in its own. Equal rows are counted first, before
    any shuffle, and each copy gets a number and so a hash of its own: the copies
    of one row spread like different rows, even where they are a third of the table.
    `copies` of them are given by one task. An error if there is a column `place` already.
    """
    if place in df.columns:
        raise ValueError(f"there is a column {place!r} already")
    columns = [F.col(f"`{c}`") for c in df.columns]
    counted = materialise(df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies")), "counted")
    # One of the fixed forms of a timestamp would leave out microseconds.
    whole = {"ignoreNullFields": "false", "timestampFormat": TIMESTAMP, "timestampNTZFormat": TIMESTAMP}
    row = F.to_json(F.struct(*columns), whole)
    last = F.expr(f"(_copies - 1) div {copies}")
    chunks = counted.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    parts = partition_count(df)
    if (counted.agg(F.max("_copies")).first()[0] or 0) > copies:
        chunks = chunks.repartition(parts, *columns, "_chunk")
    first = F.col("_chunk") * copies
    numbers = F.sequence(first, F.least(F.col("_copies"), first + copies) - 1)
    rows = chunks.withColumn("_copy", F.explode(numbers))
    rows = rows.withColumn("_hash", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("_copy").cast("string"), row), 256))
    bits = math.ceil(math.log2(parts)) if parts > 1 else 0
    bucket = F.shiftright(F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long"), 32 - bits)
    rows = materialise(rows.select(*columns, "_hash", bucket.alias("_bucket")), "hashed")
    # As many rows as buckets, which are bounded.
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash"))
    placed = rows.withColumn("_nth", within).join(F.broadcast(offsets), "_bucket")
    return placed.select(*columns, (F.col("_before") + F.col("_nth") - 1).cast("long").alias(place))


def after_cursor(hits: DataFrame, cursor: DataFrame | None, score: str, key: str) -> DataFrame:
    """The hits that come after the `cursor(query_id, score, key)` of their query, by falling score and then key.

    A query without a cursor keeps all its hits. This is a filter below the ranking: what was shown is never ranked again.
    """
    if cursor is None:
        return hits
    last = cursor.select("query_id", F.col(score).alias("_score"), F.col(key).alias("_key"))
    met = hits.join(F.broadcast(last) if is_small(last) else last, "query_id", "left")
    below = (F.col(score) < F.col("_score")) | ((F.col(score) == F.col("_score")) & (F.col(key) > F.col("_key")))
    return met.filter(F.col("_score").isNull() | below).drop("_score", "_key")


def next_cursor(page: DataFrame, score: str, key: str, before: DataFrame | None = None) -> DataFrame:
    """The last hit of each query of a page; a query whose page is empty keeps the cursor that it had."""
    last = page.groupBy("query_id").agg(F.max(F.struct("rank", score, key)).alias("_last"))
    found = last.select("query_id", F.col(f"_last.{score}").alias(score), F.col(f"_last.{key}").alias(key))
    return found if before is None else found.unionByName(before.join(found, "query_id", "left_anti"))

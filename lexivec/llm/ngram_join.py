"""Join of documents by the Jaccard similarity of their word shingles, over prefixes of tokens and token pairs.

The tokens of a document are its distinct 4-word shingles. Two sets of sizes n and m link when their similarity is
at least `percent` hundredths; then at most `n - ceil(percent * n / 100)` tokens of a set are not in the other.

1. One pass hashes the texts: size and 128-bit hash of each set, a bitmap of it, and counts of tokens in 2^20 cells.
   The counts, of fixed size, order all tokens: those of cells that hold no more than chance puts there are the rare
   class, ordered by hash; the others are frequent and come last, ordered by count. Tokens that share a cell share
   its class; any class and order give right results. Documents of equal sets are one class from here on.
2. A second pass makes the keys. The first p = n - ceil(percent * n / 100) + 1 tokens are the prefix, and two linked
   sets share their first common token there. A document whose prefix is rare is indexed by those single tokens.
   One that has only r < p rare tokens is indexed by these, and its prefix is extended for the frequent ones: if two
   linked sets share no rare token, at most p - 1 - r of its frequent tokens are not shared, and each of those,
   or of the other set, stands between only two neighbouring shared ones. So among its first
   2 (p - 1 - r) + (100 - percent) n / percent + 2 frequent tokens there are two neighbours that are neighbours in
   the other set too. The combinations of two neighbours are its keys: far fewer documents hold both than either.
3. Of each key, every class is compared with the class that meets most others, and components of the links are
   found. Then only pairs of a key that are still in different components are compared, none with the centre again; so
   large groups of near copies become stars, and no link that joins two components is lost.
4. Before sets are fetched, sizes must fit, and the bitmaps: each token flips one bit, so bits that differ are tokens
   of one set only. They bound the similarity from above and never rule out a link. Bitmaps have at least four bits
   a token; half of a longer one is folded on the other.
5. What is left is verified on the full sets.

Defined cases: null and blank texts have no shingles and are linked with nothing; a text of fewer than four words has
one shingle, its whole sequence. Rows are known by id and hash of the text; a row without an id is linked like any
other, comes after all ids (2^63 - 1 is no id) and gets no component id. Rows that repeat are one. Other columns play
no part, whatever their names. `percent` is at least 67, which the count of neighbours needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.llm.components import components
from lexivec.llm.near_dup import NO_ID, WEIGHTS, mix64, row_key
from lexivec.llm.shared import looked_up, saved
from lexivec.scale import is_small

SHINGLE = 4
PERCENT = 85
LEAST_PERCENT = 67
#: Cells in which tokens are counted, as a power of two.
CELL_BITS = 20
#: A token is frequent if its cell holds this many standard deviations, and this many more, over the usual count.
FREQUENT, FREQUENT_LEAST = 6, 8
#: The largest count of a cell that a task reports.
MOST = 2**16 - 1
#: Longs of a bitmap that are compared first, one by one.
HEAD = 16
SET = ["a", "b"]


def tokens(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and the six blanks only
    if not words:
        return np.empty(0, np.uint64)
    hashes = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    width = min(size, len(words))
    total = np.full(len(words) - width + 1, len(words) if len(words) < size else size, np.uint64)
    for k in range(width):
        total = mix64(total * WEIGHTS[0] + hashes[k : k + len(total)])
    return np.unique(total)


def bitmap(found: np.ndarray) -> np.ndarray:
    """The parity of tokens by place: at least four bits a token, a power of two of longs and `HEAD` at least."""
    longs = max(HEAD, 1 << max(0, int(4 * len(found) - 1).bit_length() - 6))
    places = (mix64(found + WEIGHTS[2]) & np.uint64(64 * longs - 1)).astype(np.int64)
    odd = (np.bincount(places, minlength=64 * longs) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def unshared(percent: int, n: int) -> int:
    """How many tokens of a set of this size may not be in a linked set."""
    return n - -(-percent * n // 100)


def keys(found: np.ndarray, classes: np.ndarray, percent: int) -> np.ndarray:
    """The index keys of a set; `classes` is 0 for rare tokens and rises with the count for frequent ones."""
    n = len(found)
    if not n:
        return np.empty(0, np.int64)
    own = classes[(found & np.uint64(len(classes) - 1)).astype(np.int64)]
    ordered = found[np.lexsort((found, own))]
    rare, prefix = int((own == 0).sum()), unshared(percent, n) + 1
    single = mix64(ordered[: min(rare, prefix)] + WEIGHTS[1])
    if rare >= prefix:
        return single.view(np.int64)
    reach = 2 * (prefix - 1 - rare) + (100 - percent) * n // percent + 2
    frequent = mix64(ordered[rare : rare + reach] + WEIGHTS[3])
    pairs = mix64(frequent[:-1] * WEIGHTS[0] + frequent[1:])
    return np.concatenate([single, pairs]).view(np.int64)


def set_hash(found: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set."""
    mixed = mix64(found + WEIGHTS[1])
    second = np.bitwise_xor.reduce(mix64(mixed ^ WEIGHTS[2]), initial=np.uint64(0))
    return int(mixed.sum(dtype=np.uint64).view(np.int64)), int(second.view(np.int64))


def profiles(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """row, n, a and b (hash of the set), bits; and one row per task with `cells`, its counts of tokens by cell."""
    cells = 1 << CELL_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cells, np.uint32)
        for batch in batches:
            sizes, first, second, maps = [], [], [], []
            for value in batch.column(1):
                found = tokens(value.as_py())
                np.add.at(counts, (found & np.uint64(cells - 1)).astype(np.int64), np.uint32(1))
                a, b = set_hash(found)
                sizes.append(len(found))
                first.append(a)
                second.append(b)
                maps.append(bitmap(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(row), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()),
                    pa.array(maps, pa.list_(pa.int64())), pa.nulls(len(sizes), pa.binary()),
                ],
                names=names,
            )
        nothing = [pa.nulls(1, t) for t in (row, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))]
        few = np.minimum(counts, MOST).astype(np.uint16)  # the order needs no more
        yield pa.RecordBatch.from_arrays([*nothing, pa.array([few.tobytes()], pa.binary())], names=names)

    names = ["row", "n", "a", "b", "bits", "cells"]
    row = pa.struct([("id", pa.int64()), ("hash", pa.int64())])
    narrow = docs.select(row_key(doc_id, text).alias("row"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "row struct<id: long, hash: long>, n long, a long, b long, bits array<long>, cells binary")


def token_classes(profiled: DataFrame) -> np.ndarray:
    """The class of each cell: 0 if rare, else a value that rises with its count. 2^20 bytes, whatever the corpus."""
    cells = 1 << CELL_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for counts in batch.column(0):
                total += np.frombuffer(counts.as_py(), np.uint16)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["cell", "count"])

    counted = profiled.filter("cells IS NOT NULL").select("cells").mapInArrow(run, "cell long, count long")
    counted = saved(counted.groupBy("cell").agg(F.sum("count").alias("count")), "cells")
    usual = counted.agg(F.median("count")).first()[0] or 0
    table = counted.filter(F.col("count") > usual + FREQUENT * usual**0.5 + FREQUENT_LEAST).toArrow()  # a row a cell at most
    classes = np.zeros(cells, np.uint8)
    classes[table["cell"].to_numpy()] = 1 + np.minimum(4 * np.log2(np.maximum(table["count"].to_numpy(), 1)), 250)
    return classes


def indexed(docs: DataFrame, classes: np.ndarray, percent: int, text: str, doc_id: str) -> DataFrame:
    """row, a, b (hash of the set), n and keys of every row that has tokens."""
    sent = docs.sparkSession.sparkContext.broadcast(classes)
    row = pa.struct([("id", pa.int64()), ("hash", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [tokens(value.as_py()) for value in batch.column(1)]
            some = [len(found) > 0 for found in sets]
            sets = [found for found in sets if len(found)]
            hashes = [set_hash(found) for found in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(row).filter(pa.array(some, pa.bool_())),
                    *(pa.array([h[k] for h in hashes], pa.int64()) for k in range(2)),
                    pa.array([len(found) for found in sets], pa.int64()),
                    pa.array([keys(found, sent.value, percent) for found in sets], pa.list_(pa.int64())),
                ],
                names=["row", "a", "b", "n", "keys"],
            )

    narrow = docs.select(row_key(doc_id, text).alias("row"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "row struct<id: long, hash: long>, a long, b long, n long, keys array<long>")


def _sizes_fit(percent: int, n: Column, m: Column) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _fitting(percent: int) -> Column:
    """Sizes of two sets, and the heads of their bitmaps, allow a link: columns n_u, n_v, head_<k>_u, head_<k>_v."""
    n, m = F.col("n_u"), F.col("n_v")
    differ = sum((F.bit_count(F.col(f"head_{k}_u").bitwiseXOR(F.col(f"head_{k}_v"))) for k in range(HEAD)), F.lit(0))
    return _sizes_fit(percent, n, m) & (differ <= F.floor((100 - percent) * (n + m) / (100 + percent)))


def _sided(table: DataFrame, side: str, *named: str) -> DataFrame:
    """`table` with its columns marked by a side, but for those named."""
    return table.select(*named, *(F.col(c).alias(f"{c}_{side}") for c in table.columns if c not in named))


def _with_bits(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that sizes and bitmaps do not rule out."""
    for side in "uv":
        pairs = pairs.join(_sided(bits.withColumnRenamed("class", side), side, side), side)
    n, m, x, y = (F.col(f"{c}_{s}") for c in ("n", "bits") for s in "uv")

    def folded(z: Column, other: Column) -> Column:
        half = (F.size(z) / 2).cast("int")
        parts = F.zip_with(F.slice(z, F.lit(1), half), F.slice(z, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(z) > F.size(other), parts).otherwise(z)

    differ = F.zip_with(folded(x, y), folded(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    most = F.floor((100 - percent) * (n + m) / (100 + percent))
    # Sizes come first: those of fitting sets are equal or one is twice the other.
    return pairs.filter(_fitting(percent)).filter(F.aggregate(differ, F.lit(0), lambda s, k: s + k) <= most).select("u", "v")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, text: str, doc_id: str) -> DataFrame:
    """The pairs (u, v) of classes whose full sets are similar enough; only one text of each class is read."""
    needed = pairs.select(F.col("u").alias("class")).union(pairs.select("v")).distinct()
    needed = saved(classes.select("class", "row").join(needed, "class"), "needed")
    texts = docs.select(row_key(doc_id, text).alias("row"), F.col(text).alias("text"))
    found = texts.join(F.broadcast(needed) if is_small(needed) else needed, "row").select("class", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [tokens(v.as_py()).view(np.int64) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["class", "tokens"])

    sets = saved(found.mapInArrow(run, "class long, tokens array<long>").dropDuplicates(["class"]), "sets")
    left = sets.select(F.col("class").alias("u"), F.col("tokens").alias("left"))
    right = sets.select(F.col("class").alias("v"), F.col("tokens").alias("right"))
    shared = F.size(F.array_intersect("left", "right")).cast("long")
    both = pairs.join(left, "u").join(right, "v").filter(100 * shared >= percent * (F.size("left") + F.size("right") - shared))
    return saved(both.select("u", "v"), "links")


def ngram_links(docs: DataFrame, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """row, n and set (a, b) of every row, and of each set with tokens its number and root (of one component iff equal)."""
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent must be {LEAST_PERCENT} to 100, not {percent}")
    profiled = saved(profiles(docs, text, doc_id), "profiles")
    keyed = indexed(docs, token_classes(profiled), percent, text, doc_id).dropDuplicates(SET)
    keyed = saved(keyed.withColumn("class", F.monotonically_increasing_id()), "keyed")  # numbers hold from here on
    classes = keyed.select("class", *SET, "row")
    # A key of one class has nothing to meet: keys are counted alone, and only those of several are gathered.
    each = keyed.select(F.explode("keys").alias("key"), "class")
    crowded = saved(each.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "crowded")
    members = saved(each.join(crowded, "key"), "members")
    # The class that meets most others is the centre of its keys: of near copies of one text, that with the fewest changes.
    weights = members.groupBy("class").agg(F.sum("size").alias("weight")).join(keyed.select("class", "n"), "class")
    weighed = saved(members.drop("size").join(weights, "class"), "weighed")
    centres = weighed.groupBy("key").agg(F.max(F.struct("weight", "class", "n")).alias("c")).select("key", F.col("c.class").alias("v"), F.col("c.n").alias("m"))
    around = saved(weighed.join(centres, "key").filter("class <> v").select("key", "class", "n", "v", "m"), "around")
    wanted = classes.join(members.select("class").distinct(), "class").select("class", *SET)
    maps = profiled.filter("n > 0").select(*SET, "n", "bits").join(wanted, SET).dropDuplicates(["class"])
    heads = [F.aggregate(_every("bits", k), F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x)).alias(f"head_{k}") for k in range(HEAD)]
    bits = saved(maps.select("class", "n", "bits", *heads), "bits")
    stars = around.filter(_sizes_fit(percent, F.col("n"), F.col("m"))).select(F.col("class").alias("u"), "v").distinct()
    links = _verified(saved(_with_bits(stars, bits, percent), "stars"), classes, docs, percent, text, doc_id)
    roots = saved(components(links), "roots")
    rest = saved(_with_bits(_across(around, roots, bits, percent), bits, percent), "rest")
    more = _verified(rest, classes, docs, percent, text, doc_id)
    roots = saved(components(links.union(more)), "roots").select(F.col("node").alias("class"), "root")
    of_class = classes.drop("row").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    return profiled.filter("cells IS NULL").select("row", "n", *SET), of_class


def _every(array: str, k: int) -> Column:
    """The elements of an array at places k, k + HEAD, ..."""
    return F.transform(F.sequence(F.lit(k), F.size(array) - HEAD + k, F.lit(HEAD)), lambda i: F.get(array, i))


def _across(around: DataFrame, roots: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Pairs of one key in different components, without its centre, which all have met, that sizes and heads allow."""
    placed = around.join(roots, F.col("class") == F.col("node"), "left").select("key", "class", F.coalesce("root", "class").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
    open_rows = saved(placed.join(mixed, "key").join(bits.drop("bits"), "class"), "open")
    pairs = _sided(open_rows, "u", "key").join(_sided(open_rows, "v", "key"), "key")
    pairs = pairs.filter((F.col("class_u") > F.col("class_v")) & (F.col("root_u") != F.col("root_v")) & _fitting(percent))
    return pairs.select(F.col("class_u").alias("u"), F.col("class_v").alias("v")).distinct()


def ngram_components(docs: DataFrame, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id (smallest id reachable by links)."""
    rows, of_class = ngram_links(docs, percent, text, doc_id)
    least = saved(rows.filter("n > 0").groupBy(*SET).agg(F.min("row").alias("row")).join(of_class, SET), "least")
    first = least.join(least.groupBy("root").agg(F.min("row").alias("first")), "root").select(*SET, "first")
    none = rows.filter("n = 0").withColumn("first", F.col("row"))
    found = looked_up(rows.filter("n > 0"), SET, first, "row").select(*none.columns).union(none)
    own, smallest = (F.nullif(F.col(c)["id"], F.lit(NO_ID)) for c in ("row", "first"))
    return found.select(own.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(own.isNotNull(), smallest).alias("component_id"))

"""Near-duplicate documents by circulant MinHash, with exact verification of every link.

Two permutations make all coordinates of a signature: `sigma` scatters a shingle over the ring of 2^32
places, and coordinate k is the smallest value that `pi`, shifted by k places round the ring, gives to any
shingle of the document. Both are bijections of 32-bit numbers.

1. One pass over the texts makes a narrow table: number of shingles, hash of the whole set, band keys.
2. Rows are known by id and hash of the text. Rows with equal sets are one class, known by its smallest row; only
   classes go on.
3. In each bucket (band and key) every class is compared with the bucket's smallest, on full sets. Buckets
   of thousands of near copies become stars, not all pairs.
4. Components of those links are found. Only pairs of one bucket that are still in different components
   are then compared, so no link between candidates is lost, and components are found again.
5. Before full sets are fetched, pairs must agree in a sketch: two bits of each of 256 coordinates. The
   allowed disagreement is five standard deviations above what a pair at the threshold has. They must also agree in
   a map of 1024 bits, odd or even numbers of shingles: every bit that differs is a shingle of one set only, so this
   rules out no link. It tells groups of middling similarity apart, whose pairs would else all be verified.

With 32 bands of 4 coordinates a pair of similarity 0.75 shares no bucket with probability 5e-6, and fails
the sketch with probability 3e-7; both are less above. Links themselves are exact: 100 * intersection >= 75 * union on the full shingle sets.

Defined cases: null and blank texts have no shingles and are linked with nothing. A text of fewer than
five words has one shingle, its whole sequence. Rows that repeat an id with other texts are linked each by its
own text. A row without an id is linked like any other and comes after all ids (2^63 - 1 is no id);
`near_duplicates` gives it no component id and calls it kept, while `deduplicated` keeps one row of each component,
also of rows that repeat id and text. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexivec.llm.components import components
from lexivec.llm.shared import same, saved
from lexivec.scale import is_small

SHINGLE = 5
PERCENT = 75
BANDS = 32
ROWS = 4
#: Coordinates of the sketch; the first bands * rows of them make the bands.
SKETCH = 256
#: Longs of the map that tells whether a set has an odd number of shingles for each of its bits; a power of two.
PARITY = 16
#: Stands for a missing id, after all others.
NO_ID = 2**63 - 1
#: Odd multipliers that combine the word hashes of a shingle.
WEIGHTS = (
    np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix32(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and the six blanks only
    if not words:
        return np.empty(0, np.uint64)
    hashes = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    if len(words) < SHINGLE:
        whole = np.array([len(words)], np.uint64)
        for k in range(len(words)):
            whole = mix64(whole * WEIGHTS[0] + hashes[k : k + 1])
        return whole
    n = len(hashes) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        total = mix64(total * WEIGHTS[k] + hashes[k : k + n])
    return np.unique(total)


def signature(shingles: np.ndarray, size: int, block: int = 1024) -> np.ndarray:
    """Circulant MinHash: coordinate k is the least pi(sigma(s) + k) over the shingles s."""
    places = mix32((shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32))  # sigma
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    least = np.full(size, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(places), block):
        values = mix32(places[None, start : start + block] * np.uint32(0x9E3779B1) + shifts)  # pi, shifted
        np.minimum(least, values.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.arange(bands, dtype=np.uint64)
    for part in least.reshape(bands, rows).T:
        keys = mix64(keys * WEIGHTS[0] + part)
    return keys.view(np.int64)


def sketch(least: np.ndarray) -> np.ndarray:
    """Two bits of every coordinate, in 64-bit words."""
    bits = np.concatenate([least & np.uint32(1), (least >> np.uint32(1)) & np.uint32(1)]).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def parity(shingles: np.ndarray) -> np.ndarray:
    """Whether an odd number of the shingles fall on each bit, in 64-bit words."""
    size = 64 * PARITY
    odd = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def agree(left: str, right: str, percent: int) -> Column:
    """Whether two sketches may belong to sets of this similarity."""
    apart = 1 - percent / 100
    most = int(SKETCH * apart + 5 * (SKETCH * apart * (1 - apart) + SKETCH * apart / 2) ** 0.5)
    words = range(2 * SKETCH // 64)
    return sum((F.bit_count(F.col(left)[i].bitwiseXOR(F.col(right)[i])) for i in words), F.lit(0)) <= most


def differ_little(left: str, right: str, left_n: str, right_n: str, percent: int) -> Column:
    """Whether sets of these maps and sizes may be similar enough: never false for those that are."""
    both = (F.col(left_n) + F.col(right_n)).cast("long")
    most = both - 2 * F.ceil(percent * both / F.lit(100 + percent))
    return sum((F.bit_count(F.col(left)[i].bitwiseXOR(F.col(right)[i])) for i in range(PARITY)), F.lit(0)) <= most


def row_key(doc_id: str, text: str) -> Column:
    """What a row is known by: id and hash of the text."""
    return F.struct(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("hash"))


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """row, n_shingles, set_a and set_b (hash of the set), band keys, sketch, parity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, first, second, keys, sketches, parities = [], [], [], [], [], []
            for value in batch.column(1):
                found = shingle_set(value.as_py())
                counts.append(len(found))
                mixed = mix64(found + WEIGHTS[1])
                first.append(int(mixed.sum(dtype=np.uint64).view(np.int64)))
                second.append(int(np.bitwise_xor.reduce(mix64(mixed ^ WEIGHTS[2]), initial=np.uint64(0)).view(np.int64)))
                least = signature(found, max(SKETCH, bands * rows)) if len(found) else None
                keys.append(None if least is None else band_keys(least[: bands * rows], bands, rows))
                sketches.append(None if least is None else sketch(least[:SKETCH]))
                parities.append(None if least is None else parity(found))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(first, pa.int64()),
                    pa.array(second, pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(sketches, pa.list_(pa.int64())),
                    pa.array(parities, pa.list_(pa.int64())),
                ],
                names=["row", "n_shingles", "set_a", "set_b", "keys", "sketch", "parity"],
            )

    narrow = docs.select(row_key(doc_id, text).alias("row"), F.col(text).alias("text"))
    made = "row struct<id: long, hash: long>, n_shingles long, set_a long, set_b long, keys array<long>, sketch array<long>, parity array<long>"
    return narrow.mapInArrow(run, made)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """row and the full shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingle_set(v.as_py()).view(np.int64) for v in batch.column(1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], names=["row", "shingles"])

    return docs.mapInArrow(run, "row struct<id: long, hash: long>, shingles array<long>")


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough; only texts of these pairs are read."""
    needed = saved(pairs.select(F.col("u").alias("row")).union(pairs.select("v")).distinct(), "needed")
    wanted = F.broadcast(needed) if is_small(needed) else needed
    sets = saved(shingle_sets(texts.join(wanted, "row", "left_semi")).dropDuplicates(["row"]), "sets")
    first = sets.select(F.col("row").alias("u"), F.col("shingles").alias("left"))
    second = sets.select(F.col("row").alias("v"), F.col("shingles").alias("right"))
    both = pairs.join(second, "v").join(first, "u")
    shared = F.size(F.array_intersect("left", "right"))
    union = F.size("left") + F.size("right") - shared
    return both.filter(100 * shared.cast("long") >= percent * union.cast("long")).select("u", "v")


def rooted(
    docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """One row per row of `docs`: row, n_shingles, root (smallest row reachable)."""
    signed = saved(signatures(docs, bands, rows, text, doc_id), "signatures")
    sets = ["n_shingles", "set_a", "set_b"]
    classes = saved(
        signed.filter("n_shingles > 0").groupBy(*sets).agg(F.min("row").alias("rep")), "classes"
    )
    # Of a class, only the row of its smallest id is looked at further.
    leaders = signed.join(classes.select("rep").distinct(), F.col("row") == F.col("rep")).dropDuplicates(["row"])
    leaders = saved(leaders, "leaders")
    sketches = leaders.select("row", "sketch", "parity")
    placed = leaders.select("row", "n_shingles", F.posexplode("keys").alias("band", "key"))
    buckets = placed.groupBy("band", "key").agg(
        F.min("row").alias("center"), F.min_by("n_shingles", "row").alias("center_n"), F.count(F.lit(1)).alias("size")
    )
    crowded = saved(buckets.filter("size > 1").drop("size"), "buckets")
    close = 100 * F.least("n_shingles", "center_n") >= percent * F.greatest("n_shingles", "center_n")
    members = saved(placed.join(crowded, ["band", "key"]), "members")
    stars = saved(
        members.filter("row <> center")
        .filter(close)
        .select(F.col("center").alias("u"), F.col("row").alias("v"), F.col("center_n").alias("n_u"), F.col("n_shingles").alias("n_v"))
        .distinct()
        .join(sketches.select(F.col("row").alias("v"), F.col("sketch").alias("right"), F.col("parity").alias("odd_v")), "v")
        .join(sketches.select(F.col("row").alias("u"), F.col("sketch").alias("left"), F.col("parity").alias("odd_u")), "u")
        .filter(agree("left", "right", percent) & differ_little("odd_u", "odd_v", "n_u", "n_v", percent))
        .select("u", "v"),
        "stars",
    )
    texts = docs.select(row_key(doc_id, text).alias("row"), F.col(text).alias("text"))
    links = saved(verified(stars, texts, percent), "links")
    roots = saved(components(links), "roots")
    rest = saved(_across(members, roots, sketches, percent).join(stars, ["u", "v"], "left_anti"), "rest")
    roots = saved(components(links.union(saved(verified(rest, texts, percent), "links"))), "roots")
    of_class = classes.join(roots, F.col("rep") == F.col("node"), "left").select(
        *sets, F.coalesce("root", "rep").alias("root")
    )
    return (
        signed.select("row", *sets)
        .join(of_class, sets, "left")
        .select("row", "n_shingles", F.coalesce("root", "row").alias("root"))
    )


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable), kept."""
    own, least = (F.nullif(F.col(c)["id"], F.lit(NO_ID)) for c in ("row", "root"))
    found = rooted(docs, **options).select(
        own.alias("doc_id"), "n_shingles", F.when(own.isNotNull(), least).alias("component_id")
    )
    return found.withColumn("kept", same(F.col("doc_id"), F.col("component_id")))


def _across(members: DataFrame, roots: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs of one bucket that are in different components, of similar size and with agreeing sketches and maps."""
    placed = members.join(roots, F.col("row") == F.col("node"), "left").select(
        "band", "key", "row", "n_shingles", F.coalesce("root", "row").alias("root")
    )
    mixed = placed.groupBy("band", "key").agg((F.min("root") != F.max("root")).alias("mixed")).filter("mixed").drop("mixed")
    open_rows = saved(placed.join(mixed, ["band", "key"]).join(sketches, "row"), "open")
    left, right = (
        open_rows.select("band", "key", *(F.col(c).alias(f"{c}_{s}") for c in ("row", "n_shingles", "root", "sketch", "parity")))
        for s in ("a", "b")
    )
    near = 100 * F.least("n_shingles_a", "n_shingles_b") >= percent * F.greatest("n_shingles_a", "n_shingles_b")
    apart = (F.col("row_a") < F.col("row_b")) & (F.col("root_a") != F.col("root_b"))
    alike = agree("sketch_a", "sketch_b", percent) & differ_little("parity_a", "parity_b", "n_shingles_a", "n_shingles_b", percent)
    pairs = left.join(right, ["band", "key"]).filter(apart & near & alike)
    return pairs.select(F.col("row_a").alias("u"), F.col("row_b").alias("v")).distinct()


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options: int) -> DataFrame:
    """One row of each component, that of the smallest id and text hash, in the columns of `docs`.

    Of rows that repeat id and text, the first by all columns as JSON stays. Rows without shingles all stay.
    """
    judged = saved(rooted(docs, text=text, doc_id=doc_id, **options).filter("n_shingles > 0"), "judged")
    gone = judged.filter(F.col("row") != F.col("root")).select(F.col("row").alias("_n_row")).distinct()
    left = docs.join(gone, row_key(doc_id, text) == F.col("_n_row"), "left_anti")
    repeats = judged.filter(F.col("row") == F.col("root")).groupBy(F.col("row").alias("_n_row")).count()
    repeats = saved(repeats.filter("count > 1").select("_n_row"), "repeats")
    once = left.join(repeats, row_key(doc_id, text) == F.col("_n_row"), "left_anti")
    again = left.withColumn("_n_key", row_key(doc_id, text)).join(repeats, F.col("_n_key") == F.col("_n_row"), "left_semi")
    order = Window.partitionBy("_n_key").orderBy(F.to_json(F.struct(*docs.columns)))
    first = again.withColumn("_n_place", F.row_number().over(order)).filter("_n_place = 1")
    return once.union(first.select(*docs.columns))

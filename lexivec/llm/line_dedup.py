"""Line dedup: an exact set-similarity join over the lines of all documents, in SQL functions only.

A line is the set of its lower-cased words. A line is removed if an earlier line (smaller document id, then
smaller line number; its own document counts too) has the same set or a Jaccard similarity of at least
`percent` hundredths. Lines of fewer than `min_words` different words always stay.

1. Words are counted over all texts, in 2^18 hash cells whose counts are kept on a logarithmic scale: a
   fixed-size array that orders words by rarity. Cells that share words only make the order less sharp.
   Any total order is right for what follows.
2. A line becomes its sorted word keys (rarity, then hash). Lines with equal sets are one class, known by
   its first line; only the rarest words of each class, its prefix, are written, bucketed by word.
3. Stars: each class is compared with the first class in each of its words' lists. That settles large
   groups of near copies with one comparison each.
4. The rest: every class that has no earlier match yet is joined with all earlier classes of its prefix
   words, under the length filter, the positional filter and the shorter index prefix of the shorter line.
   A 64-bit map of each line's words, odd or even in number for each bit, bounds the intersection from above and
   spares hopeless pairs.
5. The words of the lines of candidate pairs are fetched. A map of 512 bits made from them bounds the intersection of
   lines of hundreds of words too; the pairs that are left are verified on the words themselves.

Steps 3 and 4 answer which lines go, with one earlier match for each. `line_links` leaves no link out: it joins
all classes with all earlier ones of their prefix words, and gives class pairs and the members of each class.
Its candidates and links grow with the square of a group of near copies.

Defined cases: null texts have no lines; blank lines are neither removed nor counted. A row is known by id
and hash of its text, and rows are in this order; a null id sorts first. Rows that repeat id and text are one
document: what is removed from one is removed from all. Other columns are passed on, but for names that begin
with `_l_`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexivec.llm.quality import without_lines
from lexivec.llm.shared import BLANKS, saved, words
from lexivec.scale import is_small

PERCENT = 85
MIN_WORDS = 5
#: Cells of the rarity table, as a power of two.
CELL_BITS = 18
#: Bits of a word key below its rarity.
KEY_BITS = 56
#: Longs of the map that tells whether a line has an odd number of words for each of its bits; a power of two.
PARITY = 8
#: Stands for a missing id, before all others.
NO_ID = -(2**63)


def row_key(doc_id: str, text: str) -> Column:
    """What a row is known by: id and hash of the text."""
    return F.struct(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("hash"))


def line_words(line: Column) -> Column:
    return words(F.lower(line))


def rarity_cells(docs: DataFrame, text: str = "text") -> bytes:
    """The rarity (4 * log2 of the count) of every cell: 2^18 bytes, whatever the corpus."""
    cells = 1 << CELL_BITS
    spark = docs.sparkSession
    counted = (
        docs.select(F.explode(words(F.lower(F.col(text)))).alias("word"))
        .groupBy(F.xxhash64("word").bitwiseAND(F.lit(cells - 1)).alias("cell"))
        .count()
    )
    rarity = F.least(F.lit(127.0), F.floor(4 * F.log2("count"))).cast("tinyint")
    dense = spark.range(cells).join(counted, F.col("id") == F.col("cell"), "left")
    blocks = dense.groupBy(F.shiftright("id", CELL_BITS // 2).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("id", F.coalesce(rarity, F.lit(0).cast("tinyint")).alias("rarity")))).alias("b")
    )
    table = blocks.agg(F.array_sort(F.collect_list(F.struct("block", F.col("b")["rarity"].alias("r")))).alias("all"))
    return bytes(table.select(F.flatten(F.col("all")["r"])).first()[0])


def at_least(percent: int, count: Column) -> Column:
    """The least integer that is `percent` hundredths of the count."""
    return F.floor((percent * count.cast("long") + 99) / 100).cast("int")


def shared_least(percent: int, left: Column, right: Column) -> Column:
    """The least intersection of two similar sets of these sizes."""
    return F.ceil(percent * (left + right).cast("long") / F.lit(100 + percent)).cast("int")


def keyed_lines(docs: DataFrame, cells: bytes, percent: int, min_words: int, text: str, doc_id: str) -> DataFrame:
    """doc, line, n (different words), set and bits (hash and map of them), prefix (the rarest): lines of enough words."""
    lines = docs.select(
        row_key(doc_id, text).alias("doc"),
        F.posexplode(F.split(F.col(text), "\n")).alias("line", "text"),
    )
    table, low = F.lit(cells), (1 << KEY_BITS) - 1
    hashes = F.transform(line_words(F.col("text")), lambda w: F.xxhash64(w))

    def key(h: Column) -> Column:
        cell = h.bitwiseAND(F.lit((1 << CELL_BITS) - 1)).cast("int")
        rarity = F.ascii(F.substring(table, cell + 1, F.lit(1)).cast("string"))  # a byte below 128
        return F.shiftleft(rarity.cast("long"), KEY_BITS).bitwiseOR(h.bitwiseAND(F.lit(low)))

    # One set to an array, exploded: a filter on a column would be pushed below it, and the column be made once more.
    sets = F.filter(F.array(F.sort_array(F.array_distinct(F.transform(hashes, key)))), lambda keys: F.size(keys) >= min_words)
    n = F.size("keys")
    one = F.lit(1).cast("long")
    bits = F.aggregate("keys", F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(F.call_function("shiftleft", one, k.bitwiseAND(F.lit(63)).cast("int"))))

    return lines.select("doc", "line", F.explode(sets).alias("keys")).select(
        "doc", "line", n.alias("n"), F.xxhash64("keys").alias("set"), bits.alias("bits"), F.slice("keys", F.lit(1), n - at_least(percent, n) + 1).alias("prefix")
    )


def _prefix_table(lines: DataFrame, percent: int) -> tuple[DataFrame, str]:
    """word, place in the prefix, n, bits and first line of each class: a table bucketed by word, and its name."""
    spark = lines.sparkSession
    first = F.min(F.struct("doc", "line")).alias("f")
    firsts = lines.groupBy(*CLASS).agg(first, F.min_by("prefix", F.struct("doc", "line")).alias("prefix"))
    rows = firsts.select("f.doc", "f.line", "n", "bits", F.posexplode("prefix").alias("place", "word"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"line_words_{uuid.uuid4().hex}"
    # A table of the warehouse: dropping it frees its files.
    rows.repartition(buckets, "word").write.bucketBy(buckets, "word").sortBy("word").saveAsTable(name, format="parquet")
    return spark.table(name), name


def _may_match(percent: int, a: str, b: str) -> Column:
    """Length, positional and index-prefix filters for two prefix rows of one word."""
    an, bn, ap, bp = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.place"), F.col(f"{b}.place")
    length = 100 * F.least(an, bn) >= percent * F.greatest(an, bn)
    least = shared_least(percent, an, bn)
    position = F.least(an - ap, bn - bp) >= least
    # Every bit that differs is a word of one line only. The bits tell odd numbers of words, so those of long lines differ too.
    differ = F.bit_count(F.col(f"{a}.bits").bitwiseXOR(F.col(f"{b}.bits"))) <= an + bn - 2 * least
    # The shorter line needs only the first words that two lines of its length must share one of.
    shorter_n, shorter_p = F.least(an, bn), F.when(an <= bn, ap).otherwise(bp)
    return length & position & differ & (shorter_p < shorter_n - shared_least(percent, shorter_n, shorter_n) + 1)


#: What lines of equal words have in common.
CLASS = ["set", "n", "bits"]
PAIR = ["a_doc", "a_line", "b_doc", "b_line"]


def _pair(a: str, b: str) -> list[Column]:
    return [F.col(f"{s}.{c}").alias(f"{t}_{c}") for s, t in ((a, "a"), (b, "b")) for c in ("doc", "line")]


def _parity(hashes: Column) -> Column:
    """A map that tells for each of its bits whether an odd number of these hashes fall on it."""
    none = F.lit(0).cast("long")

    def part(k: int) -> Column:
        here = lambda h: F.shiftright(h, 6).bitwiseAND(F.lit(PARITY - 1)) == k
        bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
        return F.aggregate(F.filter(hashes, here), none, lambda a, h: a.bitwiseXOR(bit(h)))

    return F.array(*(part(k) for k in range(PARITY)))


def _plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that the parity of their words does not rule out: every bit that differs is a word of one line only."""
    hashed = sets.select("doc", "line", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    marks = saved(hashed.select("doc", "line", F.size("hashes").alias("n"), _parity(F.col("hashes")).alias("parity")), "marks")
    for side in "ab":
        own = marks.select(*(F.col(c).alias(f"{side}_{c}") for c in ("doc", "line", "n", "parity")))
        pairs = pairs.join(own, [f"{side}_doc", f"{side}_line"])
    differ = sum((F.bit_count(F.col("a_parity")[k].bitwiseXOR(F.col("b_parity")[k])) for k in range(PARITY)), F.lit(0))
    n, m = F.col("a_n"), F.col("b_n")
    return pairs.filter(differ <= n + m - 2 * shared_least(percent, n, m)).select(*PAIR)


def _verified(pairs: DataFrame, docs: DataFrame, percent: int, text: str, doc_id: str) -> DataFrame:
    """The pairs whose word sets are similar enough."""
    needed = saved(
        pairs.select(F.col("a_doc").alias("doc"), F.col("a_line").alias("line"))
        .union(pairs.select("b_doc", "b_line"))
        .groupBy("doc")
        .agg(F.collect_set("line").alias("lines")),
        "needed",
    )
    texts = docs.select(row_key(doc_id, text).alias("doc"), F.col(text).alias("text"))
    wanted = F.broadcast(needed) if is_small(needed) else needed
    found = (
        texts.join(wanted, "doc")
        .withColumn("all", F.split("text", "\n"))
        .select("doc", F.explode("lines").alias("line"), F.col("all"))
        .select("doc", "line", F.array_distinct(line_words(F.get("all", "line"))).alias("words"))
    )
    found = found.groupBy("doc", "line").agg(F.min("words").alias("words"))
    sets = saved(found, "line-sets")
    # Words are long: they are joined only to pairs that a short map cannot rule out.
    pairs = saved(_plausible(pairs, sets, percent), "plausible")
    left = sets.select(F.col("doc").alias("a_doc"), F.col("line").alias("a_line"), F.col("words").alias("left"))
    right = sets.select(F.col("doc").alias("b_doc"), F.col("line").alias("b_line"), F.col("words").alias("right"))
    both = pairs.join(left, ["a_doc", "a_line"]).join(right, ["b_doc", "b_line"])
    shared = F.size(F.array_intersect("left", "right"))
    return both.filter(100 * shared >= percent * (F.size("left") + F.size("right") - shared)).select(*PAIR)


def similar_lines(
    docs: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """doc, line, match_doc, match_line: the removed lines, each with an earlier line that it matches.

    doc and match_doc are row keys: id and hash of the text.
    """
    lines = saved(keyed_lines(docs, rarity_cells(docs, text), percent, min_words, text, doc_id), "lines")
    table, name = _prefix_table(lines, percent)
    order = Window.partitionBy("word").orderBy("doc", "line")
    starred = table.select("word", F.struct("doc", "line", "n", "bits", "place").alias("b"), "doc", "line")
    starred = starred.withColumn("a", F.first("b").over(order)).filter(
        (F.struct("a.doc", "a.line") != F.struct("b.doc", "b.line")) & _may_match(percent, "a", "b")
    )
    stars = saved(starred.select(*_pair("a", "b")).distinct(), "stars")
    matched = saved(_verified(stars, docs, percent, text, doc_id), "matched")
    done = matched.select(F.col("b_doc").alias("doc"), F.col("b_line").alias("line")).distinct()
    settled = F.broadcast(done) if is_small(done) else done
    unmatched = table.join(settled, ["doc", "line"], "left_anti").alias("b")
    earlier = F.struct("a.doc", "a.line") < F.struct("b.doc", "b.line")
    rest = table.alias("a").join(unmatched, (F.col("a.word") == F.col("b.word")) & earlier & _may_match(percent, "a", "b"))
    rest = saved(rest.select(*_pair("a", "b")).distinct().join(stars, PAIR, "left_anti"), "rest")
    more = saved(_verified(rest, docs, percent, text, doc_id), "matched")
    docs.sparkSession.sql(f"DROP TABLE {name}")
    witness = (
        matched.union(more)
        .groupBy(F.col("b_doc").alias("first_doc"), F.col("b_line").alias("first_line"))
        .agg(F.min(F.struct(F.col("a_doc").alias("doc"), F.col("a_line").alias("line"))).alias("w"))
    )
    firsts = lines.groupBy(*CLASS).agg(F.min(F.struct("doc", "line")).alias("f"), F.count(F.lit(1)).alias("size"))
    classes = firsts.select(*CLASS, F.col("f.doc").alias("first_doc"), F.col("f.line").alias("first_line"), "size")
    # A line of a class of its own that nothing matches stays.
    classes = classes.join(witness, ["first_doc", "first_line"], "left").filter(F.col("w").isNotNull() | (F.col("size") > 1))
    own = F.struct("doc", "line")
    first = F.struct(F.col("first_doc").alias("doc"), F.col("first_line").alias("line"))
    return (
        lines.select("doc", "line", *CLASS)
        .join(classes, CLASS)
        .withColumn("match", F.when(F.col("w").isNotNull(), F.col("w")).when(own != first, first))
        .filter("match IS NOT NULL")
        .select("doc", "line", F.col("match.doc").alias("match_doc"), F.col("match.line").alias("match_line"))
        .distinct()
    )


def line_links(
    docs: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, text: str = "text", doc_id: str = "doc_id"
) -> tuple[DataFrame, DataFrame]:
    """All links, as members and class pairs.

    Documents are row keys: id and hash of the text.
    Members: doc, line, class_doc, class_line (the first line of equal words), for every line of enough words.
    Pairs: a_doc, a_line, b_doc, b_line, the classes whose words are similar but unequal, the earlier one first.
    """
    lines = saved(keyed_lines(docs, rarity_cells(docs, text), percent, min_words, text, doc_id), "lines")
    table, name = _prefix_table(lines, percent)
    earlier = F.struct("a.doc", "a.line") < F.struct("b.doc", "b.line")
    met = table.alias("a").join(table.alias("b"), (F.col("a.word") == F.col("b.word")) & earlier & _may_match(percent, "a", "b"))
    met = saved(met.select(*_pair("a", "b")).distinct(), "met")
    pairs = saved(_verified(met, docs, percent, text, doc_id), "pairs")
    docs.sparkSession.sql(f"DROP TABLE {name}")
    firsts = lines.groupBy(*CLASS).agg(F.min(F.struct("doc", "line")).alias("f"))
    members = lines.select("doc", "line", *CLASS).join(firsts, CLASS)
    members = members.select("doc", "line", F.col("f.doc").alias("class_doc"), F.col("f.line").alias("class_line")).distinct()
    return saved(members, "members"), pairs


def count_links(docs: DataFrame, **options) -> DataFrame:
    """The members of `line_links`, each with n_links: how many other lines have equal or similar words."""
    members, pairs = line_links(docs, **options)
    own = ["class_doc", "class_line"]
    sizes = saved(members.groupBy(*own).agg(F.count(F.lit(1)).alias("size")), "sizes")
    ends = [pairs.select(*(F.col(f"{s}_{c}").alias(f"{t}_{c}") for s, t in (x, y) for c in ("doc", "line")))
            for x, y in ((("a", "class"), ("b", "other")), (("b", "class"), ("a", "other")))]
    other = sizes.select(F.col("class_doc").alias("other_doc"), F.col("class_line").alias("other_line"), "size")
    similar = ends[0].union(ends[1]).join(other, ["other_doc", "other_line"]).groupBy(*own).agg(F.sum("size").alias("similar"))
    linked = sizes.join(similar, own, "left")
    linked = linked.select(*own, (F.col("size") - 1 + F.coalesce("similar", F.lit(0))).alias("n_links"))
    return members.join(linked, own).select("doc", "line", *own, "n_links")


def _with_removed(docs: DataFrame, options: dict) -> DataFrame:
    """`docs` with `_l_removed`: its removed lines (line, match_doc, match_hash, match_line), in order."""
    found = similar_lines(docs, **options).groupBy(F.col("doc").alias("_l_doc"))
    match = F.struct("line", F.col("match_doc.id").alias("match_doc"), F.col("match_doc.hash").alias("match_hash"), "match_line")
    found = found.agg(F.array_sort(F.collect_list(match)).alias("_l_found"))
    # The key is a column of its own: who does not ask for the text gets by without shuffling it.
    keyed = docs.withColumn("_l_key", row_key(options.get("doc_id", "doc_id"), options.get("text", "text")))
    none = F.array().cast(found.schema["_l_found"].dataType)
    joined = keyed.join(found, F.col("_l_key") == F.col("_l_doc"), "left").withColumn("_l_removed", F.coalesce("_l_found", none))
    return joined.select(*docs.columns, "_l_removed")


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """`docs` with `removed` (which replaces a column of that name): its removed lines (line, match_doc, match_hash, match_line)."""
    found = _with_removed(docs, options)
    return found.select(*(c for c in docs.columns if c != "removed"), F.col("_l_removed").alias("removed"))


def clean_documents(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents without their removed lines, in the columns of `docs`; those left without a word go.

    A document that had no word before stays as it is.
    """
    found = _with_removed(docs, {"text": text, **options})
    cleaned = found.withColumn("_l_new", without_lines(F.col(text), F.col("_l_removed")["line"]))
    some = F.coalesce(F.btrim("_l_new", F.lit(BLANKS)) != "", F.lit(False))
    kept = cleaned.filter((F.size("_l_removed") == 0) | some)
    return kept.withColumn(text, F.col("_l_new")).select(*docs.columns)

"""Quality rules: how often a line stands in different documents of its host, with text statistics.

Everything here is DataFrame functions. A document's text is read once: its statistics and the hashes of
its lines are written as a narrow table, and all that follows works on that table.

* A normalised line is in lower case, with single spaces and every run of digits as one 0.
* A line's frequency in a host is the number of different texts of that host that hold it, so exact
  copies of one document count once.
* A line is over the limit if it stands in more than `max_documents` texts of its host, however large the
  host is. It stays in the first of those documents (smallest id, then smallest text hash), so that of a
  group of near copies one survives, and is removed from the others.
* A document is depleted if less than `least_left` of its words remain.

Defined cases: a null text has no words and fails the base rules. Null hosts form one host. Rows with the
same id are told apart by their text; repeated rows all get the same result. A null id sorts first.
Other columns are passed on, but for names that begin with `_q_`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.llm.shared import BLANK, BLANKS, same, saved, words

SYMBOLS = r"[#*$%&|<>]"
#: Rows of one frequent line spread over so many tasks.
SALTS = 16
#: Low bits that hold a window's place beside its hash.
PLACE_BITS = 31


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_documents: int = 20
    least_left: float = 0.5


def normal_line(line: Column) -> Column:
    spaced = F.btrim(F.regexp_replace(F.lower(line), BLANK, " "))
    return F.regexp_replace(spaced, "[0-9]+", "0")


def _shared_with_neighbour(values: str, bits: int):
    """The sorted values whose bits above `bits` equal those of the value before or after."""
    column, last = F.col(values), F.size(values) - 1

    def kept(value: Column, place: Column) -> Column:
        high = F.shiftright(value, bits)
        before = (place > 0) & (F.shiftright(F.get(column, place - 1), bits) == high)
        after = (place < last) & (F.shiftright(F.get(column, place + 1), bits) == high)
        return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

    return F.filter(column, kept)


def repeated_words(docs: DataFrame, tokens: str, out: str) -> DataFrame:
    """Adds the number of words inside 3-word windows that stand twice or more in the row.

    Windows are compared by 64-bit hash, in two sorts of plain longs: by the upper 33 bits beside the
    place, then, among those that agree, by the lower 31. A row's work is n log n for any text.
    """
    ones = (1 << PLACE_BITS) - 1

    def window_hash(i: Column) -> Column:
        return F.xxhash64(F.get(F.col(tokens), i), F.get(F.col(tokens), i + 1), F.get(F.col(tokens), i + 2))

    starts = F.when(F.size(tokens) >= 3, F.sequence(F.lit(0), F.size(tokens) - 3)).otherwise(F.array().cast("array<int>"))
    first = docs.withColumn(
        "_q_upper",
        F.sort_array(F.transform(starts, lambda i: window_hash(i).bitwiseAND(F.lit(~ones)).bitwiseOR(i.cast("long")))),
    )
    second = first.withColumn("_q_near", _shared_with_neighbour("_q_upper", PLACE_BITS)).withColumn(
        "_q_lower",
        F.sort_array(
            F.transform(
                "_q_near",
                lambda v: F.shiftleft(window_hash(v.bitwiseAND(F.lit(ones)).cast("int")), 64 - PLACE_BITS).bitwiseOR(
                    v.bitwiseAND(F.lit(ones))
                ),
            )
        ),
    )
    placed = second.withColumn("_q_same", _shared_with_neighbour("_q_lower", 64 - PLACE_BITS)).withColumn(
        "_q_places", F.sort_array(F.transform("_q_same", lambda v: v.bitwiseAND(F.lit(ones))))
    )
    covered = F.transform(
        "_q_places", lambda p, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), p - F.get(F.col("_q_places"), k - 1)))
    )
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, b: a + b)
    return placed.withColumn(out, total).drop("_q_upper", "_q_near", "_q_lower", "_q_same", "_q_places")


def measure_documents(docs: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """One narrow row per document: its statistics, and for each line with a word its number, hash and words."""
    lines = F.filter(
        F.transform(F.split("_q_text", "\n"), lambda line, n: F.struct(n.alias("line"), line.alias("text"))),
        lambda x: F.btrim(x["text"], F.lit(BLANKS)) != "",
    )
    base = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        F.coalesce(F.col(text), F.lit("")).alias("_q_text"),
    )
    split = base.withColumn("_q_words", words(F.col("_q_text"))).withColumn("_q_lines", lines)
    measured = repeated_words(split, "_q_words", "n_repeat_words")
    return measured.select(
        "doc_id",
        "host",
        F.xxhash64("_q_text").alias("text_hash"),
        F.size("_q_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_q_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_q_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_q_lines") - F.size(F.array_distinct(F.col("_q_lines")["text"]))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.transform(
            "_q_lines",
            lambda x: F.struct(
                x["line"].alias("line"),
                F.xxhash64(normal_line(x["text"])).alias("hash"),
                F.size(F.split(F.btrim(x["text"], F.lit(BLANKS)), BLANK)).alias("words"),
            ),
        ).alias("lines"),
    )


def frequent_lines(measured: DataFrame, rules: QualityRules) -> DataFrame:
    """host, hash, and the document where the line stays: lines over the limit."""
    seen = measured.select("host", "doc_id", "text_hash", F.explode("lines").alias("l"))
    return (
        seen.groupBy("host", F.col("l.hash").alias("hash"))
        .agg(F.countDistinct("text_hash").alias("texts"), F.min(F.struct("doc_id", "text_hash")).alias("first"))
        .filter(F.col("texts") > rules.max_documents)
        .select("host", "hash", "first")
    )


def lines_to_remove(measured: DataFrame, rules: QualityRules) -> DataFrame:
    """doc_id, text_hash and the lines to remove, for documents that have such lines.

    Both sides are salted, since a frequent line may stand in a third of all documents.
    """
    seen = measured.select(
        "host", "doc_id", "text_hash", F.explode("lines").alias("l"), F.pmod("text_hash", F.lit(SALTS)).alias("salt")
    ).select("host", "doc_id", "text_hash", "salt", "l.*")
    frequent = frequent_lines(measured, rules).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    frequent = frequent.withColumn("salt", F.col("salt").cast("long"))
    here = F.struct("doc_id", "text_hash")
    found = seen.join(frequent, ["host", "hash", "salt"]).filter(~same(here, F.col("first")))
    return found.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("line", "words")).alias("removed"))


def quality_rules(docs: DataFrame, rules: QualityRules = QualityRules(), **columns: str) -> DataFrame:
    """Statistics and verdict of each document, with the numbers of its removed lines."""
    measured = saved(measure_documents(docs, **columns), "quality")
    removed = lines_to_remove(measured, rules).select(
        F.col("doc_id").alias("_q_id"),
        F.col("text_hash").alias("_q_hash"),
        F.array_sort(F.col("removed")["line"]).alias("removed_lines"),
        F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("removed_words"),
    )
    joined = measured.drop("lines").join(
        removed, same(F.col("doc_id"), F.col("_q_id")) & (F.col("text_hash") == F.col("_q_hash")), "left"
    )
    failed = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")
    )
    left = F.col("n_words") - F.coalesce(F.col("removed_words"), F.lit(0))
    return joined.withColumn("base_failed", failed).select(
        "doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (left >= F.col("n_words") * rules.least_left)).alias("kept"),
        F.coalesce("removed_words", F.lit(0).cast("long")).alias("removed_words"),
        F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"),
    )


def clean_documents(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", **columns: str) -> DataFrame:
    """The kept documents without their removed lines, in the columns of `docs`."""
    verdicts = quality_rules(docs, rules, text=text, **columns).filter("kept")
    verdicts = verdicts.select(
        F.col("doc_id").alias("_q_id"), F.col("text_hash").alias("_q_hash"), F.col("removed_lines").alias("_q_removed")
    ).distinct()
    key = columns.get("doc_id", "doc_id")
    content = F.coalesce(F.col(text), F.lit(""))
    joined = docs.withColumn("_q_text", F.xxhash64(content)).join(
        verdicts, same(F.col(key), F.col("_q_id")) & (F.col("_q_text") == F.col("_q_hash"))
    )
    return joined.withColumn(text, without_lines(F.col(text), F.col("_q_removed"))).select(*docs.columns)


def without_lines(text: Column, numbers: Column) -> Column:
    """The text without the lines of these numbers; unchanged where there are none."""
    lines = F.split(text, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), numbers)
    return F.when(F.size(numbers) == 0, text).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))

"""What the operators of this folder share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.session import new_folder

#: White space between words, as a character class for regular expressions and as the characters themselves.
BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
#: Parts over which the rows of one key are dealt when they look it up.
PARTS = 1024


def saved(df: DataFrame, label: str) -> DataFrame:
    """`df` written to the shared work folder and read again.

    This cuts the lineage: a lost executor costs the tasks it ran, not the work before.
    """
    folder = new_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def words(text: Column) -> Column:
    """The runs of characters other than white space; none for null."""
    spaced = F.coalesce(text, F.lit(""))
    for blank in BLANKS[1:]:
        spaced = F.replace(spaced, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")  # a single character is split without a regular expression


def same(left: Column, right: Column) -> Column:
    """Equality that also pairs nulls."""
    return left.eqNullSafe(right)


def looked_up(rows: DataFrame, keys: list[str], table: DataFrame, part_of: str) -> DataFrame:
    """`rows` joined with the one row of `table` for their `keys`, the rows of a key dealt over `PARTS` by `part_of`.

    `table` is repeated only for the parts that there are, so a key that a third of all rows hold is split and the
    others cost no more than one row each.
    """
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(part_of), F.lit(PARTS)))
    parts = dealt.select(*keys, "_part").distinct().join(table, keys)
    return dealt.join(parts, [*keys, "_part"]).drop("_part")

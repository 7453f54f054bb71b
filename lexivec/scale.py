"""Size checks, partition counts and skew-safe ranking shared by the operators."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivec.session import new_folder, remove_folder, shuffles_freed

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024
PARTITION_BYTES = 64 * 1024 * 1024
MAX_PARTITIONS = 100_000
# From here on the best rows of a group are cut in two steps.
MANY_TASKS = 1_000


def _cell_bytes(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.NumericType):
        return F.coalesce(F.size(column), F.lit(0)) * 8 + 16
    if isinstance(field.dataType, T.ArrayType | T.MapType | T.StructType | T.VariantType):
        # Other nested values by their length as text.
        return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) * 2 + 16
    return F.lit(16)


def measure(df: DataFrame, *more: Column) -> tuple:
    """Rows and approximate bytes of a table, and further aggregates of bounded size, in one pass."""
    cells = sum((_cell_bytes(f) for f in df.schema.fields), F.lit(0))
    size = F.coalesce(F.sum(cells.cast("long")), F.lit(0))
    return tuple(df.agg(F.count(F.lit(1)).alias("rows"), size.alias("bytes"), *more).first())


def fits(rows: int, size: int, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table of this measured size may be broadcast."""
    return 0 < max_rows and rows <= max_rows and size <= max_bytes


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table, by its measured size, may be broadcast."""
    return max_rows > 0 and fits(*measure(df), max_rows, max_bytes)


def scan_bytes(df: DataFrame) -> int:
    """Size of the files that `df` reads.

    Only file scans are counted: their size is known from the file listing, while
    estimates for joins and aggregates above them can be off by any factor.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.size())]
    return sum(int(str(s.stats().sizeInBytes())) for s in scans if "Relation" in s.nodeName())


def partition_count(df: DataFrame, target: int = PARTITION_BYTES) -> int:
    """Partitions for a shuffle of `df`: one per `target` bytes of its files.

    The session's own shuffle setting is the least, and there is a most, since the
    number of shuffle blocks grows with its product with the number of map tasks.
    """
    wanted = min(math.ceil(scan_bytes(df) / target), MAX_PARTITIONS)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), wanted)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """`df`, written to the shared work folder and read again, so that it is computed once.

    The files are needed as long as the result is; remove the work folder when a job is done.
    """
    folder = new_folder(df.sparkSession, label)
    write_table(df, folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def write_table(df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """`df` as Parquet with little on disk: packed tightly, and without what was shuffled for it once it is written."""
    with shuffles_freed(df.sparkSession):
        df.write.mode(mode).option("compression", "zstd").partitionBy(*by).parquet(path)


@contextmanager
def borrowed(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """`df` as `materialise` gives it, for the time of a block: its files go with the end of the block."""
    folder = new_folder(df.sparkSession, label)
    try:
        write_table(df, folder)
        yield df.sparkSession.read.schema(df.schema).parquet(folder)
    finally:
        remove_folder(df.sparkSession, folder)


def rank_all(df: DataFrame, group: Sequence[str], order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """`row_number` per group for groups of any size.

    A plain window would sort a whole group in one task. Here rows are range
    partitioned by group and order, so a large group spreads over many
    partitions; a row's rank is its place inside its slice plus the number of
    rows in the earlier slices. The rows are written first, as range partitioning
    reads its input twice; the slices are written too, since both steps must see
    the same borders. `order` must be total. Ranks are BIGINT.
    """
    keys = [F.col(g) for g in group]
    rows = materialise(df, "rows")
    slices = rows.repartitionByRange(partition_count(rows), *keys, *order)
    sliced = materialise(slices.withColumn("_slice", F.spark_partition_id()), "slices")
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*group, "_slice")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    within = Window.partitionBy(*group, "_slice").orderBy(*order)
    return (
        sliced.withColumn("_place", F.row_number().over(within))
        .join(offsets, [*group, "_slice"])
        .withColumn(rank, F.col("_place") + F.col("_before"))
        .drop("_slice", "_place", "_before")
    )


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int | None, rank: str = "rank"
) -> DataFrame:
    """The first `k` rows of each group, with their rank; all rows where `k` is None.

    Up to the optimizer's group-limit threshold Spark cuts each task's rows to `k`
    per group before the shuffle, so no group is ever gathered whole. Where there
    are many tasks, a group is cut in parts first, so that no task gets `k` rows of
    each of them. Above the threshold the ranking is distributed by `rank_all`.
    A rank is INT where `k` bounds it, else BIGINT.
    """
    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k is None or k > threshold:
        ranked = rank_all(df, group, order, rank)
        return ranked if k is None else ranked.filter(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("int"))
    tasks = partition_count(df)
    if tasks > MANY_TASKS:
        parts = F.pmod(F.spark_partition_id(), F.lit(math.isqrt(tasks)))
        within = Window.partitionBy(*group, "_part").orderBy(*order)
        df = df.withColumn("_part", parts).withColumn("_place", F.row_number().over(within)).filter(F.col("_place") <= k)
        df = df.drop("_part", "_place")
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)

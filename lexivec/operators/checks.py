"""Checks of the input tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing field in the documents: {', '.join(missing)}")


def require_documents(df: DataFrame, key: str, at_least: int = 3) -> None:
    """An error for repeated or null ids and for too small a corpus; one pass over the ids."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("documents"),
        F.max("n").alias("most"),
        F.max_by(F.col(key), F.col("n")).alias("example"),
        F.count_if(F.col(key).isNull()).alias("nulls"),
    ).first()
    if row["nulls"]:
        raise ValueError(f"document id {key!r} is null")
    if row["most"] is not None and row["most"] > 1:
        raise ValueError(f"duplicate document id: {row['example']!r}")
    if row["documents"] < at_least:
        raise ValueError(f"the corpus has {row['documents']} documents, but needs at least {at_least}")

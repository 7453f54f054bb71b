"""Value counts, confusion matrix and per-label metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.functions.scores import half_away

# Fixed value: a guess that stands for no prediction.
UNKNOWN = "unknown"
PLACES = 4


def value_freq(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def _check_labels(labels: Sequence[str]) -> list[str]:
    if isinstance(labels, str) or len(labels) < 2:
        raise ValueError("at least two class labels are required")
    return list(dict.fromkeys(labels))


def confusion_matrix(df: DataFrame, labels: Sequence[str], truth: str = "truth", guess: str = "guess") -> DataFrame:
    """Counts `(guess, truth, n)` for every pair of labels, zeros included.

    Rows with an unlisted label, or the guess `unknown`, are not counted.
    """
    listed = _check_labels(labels)
    counted = (
        df.filter((F.col(guess) != UNKNOWN) & F.col(guess).isin(listed) & F.col(truth).isin(listed))
        .groupBy(F.col(guess).alias("guess"), F.col(truth).alias("truth"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    names = F.array(*[F.lit(name) for name in listed])
    cells = (
        df.sparkSession.range(1)
        .select(F.explode(names).alias("guess"))
        .select("guess", F.explode(names).alias("truth"))
    )
    return cells.join(counted, ["guess", "truth"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(half_away(F.try_divide(top.cast("double"), bottom.cast("double")), PLACES), F.lit(0.0))


def label_metrics(matrix: DataFrame) -> DataFrame:
    """Precision, recall and F measure of each label, to 4 places; no rows if nothing was counted."""
    hit = F.when(F.col("guess") == F.col("truth"), F.col("n")).otherwise(F.lit(0))
    guessed = matrix.groupBy(F.col("guess").alias("label")).agg(
        F.sum("n").alias("guessed"), F.sum(hit).alias("hits")
    )
    true = matrix.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("true"))
    evaluated = matrix.agg(F.sum("n").alias("n")).scalar()
    rated = (
        guessed.join(true, "label")
        .filter(evaluated > 0)
        .withColumn("precision", _ratio(F.col("hits"), F.col("guessed")))
        .withColumn("recall", _ratio(F.col("hits"), F.col("true")))
    )
    p, r = F.col("precision"), F.col("recall")
    # From the rounded values, as the metric is defined.
    return rated.withColumn("f_measure", _ratio(F.lit(2.0) * p * r, p + r)).select(
        "label", "precision", "recall", "f_measure"
    )


def macro_metrics(metrics: DataFrame) -> DataFrame:
    """Averages over the labels, to 4 places; nulls if nothing was counted."""
    return metrics.agg(
        *(half_away(F.avg(c), PLACES).alias(f"avg_{c}") for c in ("precision", "recall", "f_measure"))
    )

"""Small numeric column functions used on scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits below which a hit is flagged as low confidence.
SIM_LIMIT = 0.78
SIDE_BY_SIDE_SIM_LIMIT = 0.75
RERANK_LIMIT = 0.15


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def half_away_units(x: Column, places: int) -> Column:
    """`x` in units of 10^-places as BIGINT, halves away from zero."""
    return (F.signum(x) * F.floor(F.abs(x) * F.lit(10.0**places) + F.lit(0.5))).cast("long")


def half_away(x: Column, places: int) -> Column:
    return half_away_units(x, places) / F.lit(10.0**places)


def score_round(x: Column, places: int = 2) -> Column:
    return F.round(x, places)


def is_finite_number(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def is_finite_integer(x: Column) -> Column:
    return is_finite_number(x) & (x == F.rint(x))


def low_confidence(
    sim: Column,
    rerank_score: Column | None = None,
    sim_limit: float = SIM_LIMIT,
    rerank_limit: float = RERANK_LIMIT,
) -> Column:
    """True where the score that ranked the hit is under its limit; a rerank score, where present, decides."""
    by_sim = sim < F.lit(sim_limit)
    if rerank_score is None:
        return by_sim
    return F.when(rerank_score.isNotNull(), rerank_score < F.lit(rerank_limit)).otherwise(by_sim)

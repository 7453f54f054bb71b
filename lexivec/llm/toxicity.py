"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(grade <= k) = sigmoid(threshold_k - w.x): one weight vector is shared by all ordered thresholds. Features
are the different words of a text and their first five bytes; the model keeps those that go with the grade
in the training rows. The answer is the expected grade, the sum over k of P(grade >= k).

The model is fitted on the driver on at most `max_rows` labelled rows (those with the smallest hash of
their id) and `max_features` features; both bounds are parameters. Scoring reads every document in place,
without a shuffle.

Defined cases: a null or wordless text has no features and gets the grade of the thresholds alone. Labels
without a document, with a null grade or with a null id are not used. Without any labelled row every
severity is 0. Grades are whole numbers from 0; a grade that no row has gives no threshold of its own.
Repeated labels of one id count once, by their largest grade. Other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.decontam import TABLE
from lexivec.llm.shared import saved

MAX_ROWS = 20_000
MAX_FEATURES = 20_000
LEAST_ROWS = 3
LEAST_Z = 5.0
PREFIX = 5


def features(text: str | None) -> set[bytes]:
    words = set((text or "").lower().encode().translate(TABLE).split())
    return words | {w[:PREFIX] + b"*" for w in words if len(w) > PREFIX}


@dataclass
class Model:
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: dict[bytes, float] = field(default_factory=dict)

    def tail(self, text: str | None) -> list[float]:
        """P(grade >= k) for k = 1, 2, ..."""
        found = self.weights.keys() & features(text)
        score = math.fsum(self.weights[f] for f in found)
        return [1 / (1 + math.exp(min(max(t - score, -700), 700))) for t in self.thresholds]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(grades: np.ndarray, rows: np.ndarray, columns: np.ndarray, n_features: int, l2: float = 0.1, rounds: int = 400):
    """Thresholds and weights by gradient descent (Adam) on the penalised log likelihood.

    `rows` and `columns` list the features present. Thresholds are the first one and positive gaps.
    """
    top = int(grades.max(initial=0))
    if not len(grades) or not top:
        return np.zeros(0), np.zeros(n_features)
    n = len(grades)
    above = np.array([(grades >= k).mean() for k in range(1, top + 1)]).clip(0.5 / n, 1 - 0.5 / n)
    start = np.log((1 - above) / above)
    gaps = np.log(np.maximum(np.diff(start), 1e-3))
    theta = np.concatenate([np.zeros(n_features), start[:1], gaps])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    low_open, high_open = grades == 0, grades == top

    def edges(theta: np.ndarray) -> np.ndarray:
        return theta[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(theta[n_features + 1 :]))])

    for step in range(1, rounds + 1):
        weights, cuts = theta[:n_features], edges(theta)
        score = np.bincount(rows, weights[columns], n)
        high = np.where(high_open, 1.0, _sigmoid(cuts[np.minimum(grades, top - 1)] - score))
        low = np.where(low_open, 0.0, _sigmoid(cuts[np.maximum(grades - 1, 0)] - score))
        mass = np.maximum(high - low, 1e-12)
        slope_high, slope_low = high * (1 - high), low * (1 - low)
        by_score = (slope_high - slope_low) / mass  # of the negative log likelihood
        by_cut = np.bincount(np.minimum(grades, top - 1), np.where(high_open, 0, -slope_high / mass), top)
        by_cut += np.bincount(np.maximum(grades - 1, 0), np.where(low_open, 0, slope_low / mass), top)
        gradient = np.zeros_like(theta)
        gradient[:n_features] = np.bincount(columns, by_score[rows], n_features) + l2 * weights
        gradient[n_features] = by_cut.sum()
        for k in range(1, top):
            gradient[n_features + k] = by_cut[k:].sum() * np.exp(theta[n_features + k])
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        rate = 0.1 * min(1.0, 4 * (1 - step / (rounds + 1)))
        theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return edges(theta), theta[:n_features]


def train(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", grade: str = "grade",
    max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES,
) -> Model:
    """A model from documents and labels (doc_id, grade)."""
    graded = labels.filter(F.col(doc_id).isNotNull() & F.col(grade).isNotNull()).groupBy(F.col(doc_id).alias("_t_id"))
    graded = graded.agg(F.max(grade).cast("int").alias("_t_grade")).orderBy(F.xxhash64("_t_id"), "_t_id").limit(max_rows)
    texts = docs.select(F.col(doc_id).alias("_t_id"), F.col(text).alias("_t_text"))
    rows = texts.join(F.broadcast(graded), "_t_id").groupBy("_t_id", "_t_grade").agg(F.min("_t_text").alias("text"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                found = pa.array([sorted(features(t.as_py())) for t in part.column(1)], pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([part.column(0), found], names=["grade", "features"])

    sample = saved(rows.select(F.col("_t_grade").alias("grade"), "text").mapInArrow(listed, "grade int, features array<binary>"), "labelled")
    total = sample.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("grade") > 0).cast("long")).alias("k")).first()
    if not total["n"] or not total["k"]:
        return Model()
    share = total["k"] / total["n"]
    z = (F.col("k") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share) + 1e-9)
    chosen = (
        sample.select((F.col("grade") > 0).cast("long").alias("bad"), F.explode("features").alias("feature"))
        .groupBy("feature")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("k"))
        .filter((F.col("n") >= LEAST_ROWS) & (F.abs(z) >= LEAST_Z))
        .orderBy(F.abs(z).desc(), "feature")
        .limit(max_features)
        .select("feature")
    )
    names = [bytes(r[0]) for r in chosen.collect()]
    place = sample.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[place.value[f] for f in row.as_py() if f in place.value] for row in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["grade", "at"])

    table = sample.mapInArrow(indexed, "grade int, at array<int>").toArrow()
    lists = table.column("at").combine_chunks()
    counts = np.diff(lists.offsets.to_numpy())
    thresholds, weights = fit(
        table.column("grade").to_numpy().astype(int),
        np.repeat(np.arange(len(counts)), counts),
        lists.flatten().to_numpy(),
        len(names),
    )
    return Model(thresholds, dict(zip(names, weights.tolist(), strict=True)))


def severity(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, severity (expected grade), grade (the most likely one), toxic (P(grade >= 1) of at least one half)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = [shared.value.tail(t.as_py()) for t in batch.column(1)]
            grades = [int(np.argmax(-np.diff([1.0, *t, 0.0]))) for t in tails]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([float(sum(t)) for t in tails], pa.float64()),
                    pa.array(grades, pa.int32()),
                    pa.array([bool(t) and t[0] >= 0.5 for t in tails], pa.bool_()),
                ],
                names=["doc_id", "severity", "grade", "toxic"],
            )

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, severity double, grade int, toxic boolean")

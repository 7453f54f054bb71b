"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds the letter trigrams of all languages at once: a cell is a mask with one bit
per language, and the masks of a trigram's cells, and-ed, tell all languages that contain it. A text's
trigrams are looked up, each language's bits are counted, and the counts are corrected for the false
positives that the filter's fill makes likely. The largest corrected count decides.

Learning counts the trigrams of every training text. A trigram belongs to a language if it makes up at
least `min_share` of that language's trigrams and at least `ratio` of its largest share in any language,
so that foreign passages do not leak; no language can have more than 1 / min_share trigrams. Only the
cells, a table of fixed size, pass through the driver.

Defined cases: texts that are null or have no letters get `und` with score 0. Training rows need a text and
a language. If nothing was learned, every answer is `und`. Equal counts go to the language with more
training trigrams, then to the first by name. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivec.llm.near_dup import mix64
from lexivec.llm.shared import saved

CELL_BITS = 20
PROBES = 3
MIN_SHARE = 1e-5
RATIO = 0.25
UNKNOWN = "und"
#: Code points handled at a time.
BLOCK = 1 << 20
SPACE = 32


@cache
def letter_table() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    """A blank, the lower-cased text with blanks for all but letters, and a blank."""
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le"), np.uint32)
    return np.where(letter_table()[points], points, np.uint32(SPACE))


def trigrams(points: np.ndarray) -> np.ndarray:
    """Trigrams around each letter, as one number; 0 where the middle is a blank."""
    wide = points.astype(np.uint64)
    grams = (wide[:-2] << np.uint64(42)) | (wide[1:-1] << np.uint64(21)) | wide[2:]
    grams[points[1:-1] == SPACE] = 0
    return grams


def blocks(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Numbers of the texts of a block, where each begins among the trigrams, and the trigrams (0 for none)."""
    numbers, parts, size = [], [], 0
    for number, text in enumerate(texts):
        if not text:
            continue
        numbers.append(number)
        parts.append(trigrams(code_points(text)))
        size += len(parts[-1])
        if size >= BLOCK:
            yield numbers, np.cumsum([0, *map(len, parts[:-1])]), np.concatenate(parts)
            numbers, parts, size = [], [], 0
    if parts:
        yield numbers, np.cumsum([0, *map(len, parts[:-1])]), np.concatenate(parts)


def probes(grams: np.ndarray) -> list[np.ndarray]:
    """The cells of each trigram."""
    mixed = mix64(grams + np.uint64(0x9E3779B97F4A7C15))
    step = (mixed >> np.uint64(40)) | np.uint64(1)
    ones = np.uint64((1 << CELL_BITS) - 1)
    return [((mixed + np.uint64(j) * step) & ones).astype(np.int64) for j in range(PROBES)]


@dataclass
class Filters:
    """languages, and cells: one row of 64-bit masks for every 64 languages."""

    languages: list[str]
    cells: np.ndarray

    def false_positive(self) -> np.ndarray:
        bits = [((self.cells[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(self.languages))]
        return np.array(bits) ** PROBES

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return names, scores
        wrong = self.false_positive()
        for numbers, starts, grams in blocks(texts):
            real = grams != 0
            total = np.add.reduceat(real, starts, dtype=np.int64)
            at = probes(grams)
            found = np.empty((len(self.languages), len(starts)))
            for word, row in enumerate(self.cells):
                mask = row[at[0]]
                for more in at[1:]:
                    mask &= row[more]
                mask[~real] = 0
                for i in range(64 * word, min(64 * word + 64, len(self.languages))):
                    found[i] = np.add.reduceat((mask >> np.uint64(i % 64)) & np.uint64(1), starts, dtype=np.int64)
            corrected = np.clip((found - total * wrong[:, None]) / np.maximum(1 - wrong, 1e-9)[:, None], 0, None)
            best = corrected.argmax(axis=0)
            for k, number in enumerate(numbers):
                if total[k]:
                    names[number] = self.languages[best[k]]
                    scores[number] = min(1.0, float(corrected[best[k], k] / total[k]))
        return names, scores


def count_trigrams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, gram, n over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def rows(name: str) -> pa.RecordBatch:
            grams, counts = known.pop(name)
            arrays = [pa.array([name] * len(grams)), pa.array(grams.view(np.int64)), pa.array(counts)]
            return pa.RecordBatch.from_arrays(arrays, names=["lang", "gram", "n"])

        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            texts = batch.column(1).to_pylist()
            for name in sorted(set(names)):
                for _, _, grams in blocks([texts[i] for i in np.flatnonzero(names == name)]):
                    found, counts = np.unique(grams[grams != 0], return_counts=True)
                    old, old_counts = known.get(name, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                    merged, place = np.unique(np.concatenate([old, found]), return_inverse=True)
                    sums = np.bincount(place, np.concatenate([old_counts, counts]), len(merged)).astype(np.int64)
                    known[name] = (merged, sums)
                    if len(merged) > 2_000_000:
                        yield rows(name)
        for name in sorted(known):
            yield rows(name)

    used = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).dropna()
    return used.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(
    docs: DataFrame, text: str = "text", lang: str = "lang", min_share: float = MIN_SHARE, ratio: float = RATIO
) -> Filters:
    """Filters from all training documents."""
    counted = saved(count_trigrams(docs, text, lang), "trigrams")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    order = [(r["lang"], r["total"]) for r in totals.collect()]  # one row per language
    languages = [name for name, _ in sorted(order, key=lambda x: (-x[1], x[0]))]
    shares = counted.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share"))
    most = F.max("share").over(Window.partitionBy("gram"))  # a row per language at most
    kept = shares.withColumn("most", most).filter((F.col("share") >= min_share) & (F.col("share") >= F.col("most") * ratio))
    number = {name: i for i, name in enumerate(languages)}

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array([number[name] for name in batch.column(0).to_pylist()], np.int64)
            grams = batch.column(1).to_numpy().view(np.uint64)
            bits = (np.uint64(1) << (at % 64).astype(np.uint64)).view(np.int64)
            for cell in probes(grams):
                yield pa.RecordBatch.from_arrays([pa.array(at // 64), pa.array(cell), pa.array(bits)], names=["row", "cell", "bits"])

    masks = kept.select("lang", "gram").mapInArrow(cells, "row long, cell long, bits long")
    table = masks.groupBy("row", "cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(((len(languages) + 63) // 64, 1 << CELL_BITS), np.uint64)
    out[table.column("row").to_numpy(), table.column("cell").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return Filters(languages, out)


def identify(docs: DataFrame, filters: Filters, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, lang_pred string, score double")

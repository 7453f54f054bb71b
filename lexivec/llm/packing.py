"""Best-fit packing: documents into sequences of at most `size` tokens, by fitted length patterns.

1. Texts become token ids; a document is its ids and one end id. Longer documents are cut into pieces of
   exactly `size` ids, of which only the first may be shorter. Pieces are numbered within their task and
   length, and written as a narrow table.
2. The histogram of piece lengths, at most `size` numbers, goes to the driver. Patterns of up to three
   lengths that fill a sequence exactly are enumerated, their repeat counts are fitted to the histogram by
   non-negative least squares and rounded down to what the histogram allows.
3. What remains of the histogram is packed best fit first, from the longest length down, on counts: all
   sequences with equal room are handled together, so the work depends on `size`, not on the documents.
4. Each pattern slot takes the next pieces of its length. A piece's number among all of its length (its
   number in its task plus the counts of earlier tasks) gives its slot by a search in a small table.

Nothing but the histogram and the table of slots passes through the driver; both are bounded by `size`.

Defined cases: a null text is an empty one, which is the end id alone; a null id is passed on; repeated
rows are packed once each; an empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.shared import saved

SIZE = 1024
END = 2
# The special token of the vocabulary, and how it splits texts before the merges.
SPECIAL = "<|endoftext|>"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

LONG = 100_000
BLANK_RUN = re.compile(r"\s+")


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Texts to token ids, as little-endian unsigned 32-bit numbers.

    The vocabulary is that of the given tokenizer file; its merges are run by a faster library with the same
    ids. Texts that hold a special token, or a run of `LONG` blanks, on which that library fails, go through the
    tokenizer of the file itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model, symbols = json.loads(self.tokenizer.to_str())["model"], byte_symbols()
        ranks = {bytes(symbols[c] for c in t): i for t, i in model["vocab"].items() if t != SPECIAL}
        for i, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            if model["vocab"][left + right] != 256 + i:
                raise ValueError(f"the ids of {path} are not in the order of its merges")
        self.plain = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        own = SPECIAL in text or (len(text) >= LONG and any(len(run) >= LONG for run in BLANK_RUN.findall(text)))
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids if own else self.plain(text)
        return np.array(ids, "<u4").tobytes()


def cut(length: int, size: int) -> list[tuple[int, int]]:
    """Start and length of each piece: only the first may be shorter than `size`."""
    head = length % size or min(length, size)
    return [(0, head)] + [(start, size) for start in range(head, length, size)]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long"


def pieces(
    docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, text: str = "text", doc_id: str = "doc_id",
    with_ids: bool = False,
) -> DataFrame:
    """Every piece with the checksum of its ids (and the ids), numbered per task and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, last = Encoder(tokenizer), Counter(), np.array([end], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc, task, value in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids = encode(value or "") + last
                for number, (start, length) in enumerate(cut(len(ids) // 4, size)):
                    own = ids[4 * start : 4 * (start + length)]
                    row = (doc, number, start, length, zlib.crc32(own), task, seen[length], own)
                    for column, item in zip(out, row, strict=True):
                        column.append(item)
                    seen[length] += 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            arrays = [pa.array(v, t) for v, t in zip(out, types, strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number", "ids"]
            yield pa.RecordBatch.from_arrays(arrays[: 7 + with_ids], names=names[: 7 + with_ids])

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.spark_partition_id().alias("task"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def patterns(size: int, lengths: np.ndarray) -> np.ndarray:
    """All ways to fill `size` with up to three of the lengths, as rows in descending order, 0 for none."""
    present = np.zeros(size + 1, bool)
    present[lengths] = True
    values = np.flatnonzero(present[1:size]) + 1
    rows = [np.array([[size, 0, 0]])] if present[size] else []
    pairs = values[(values >= size - values) & present[size - values]]
    rows.append(np.stack([pairs, size - pairs, np.zeros_like(pairs)], axis=1))
    for large in values:
        rest = size - large
        middle = values[(values <= large) & (values < rest) & (2 * values >= rest)]
        middle = middle[present[rest - middle]]
        rows.append(np.stack([np.full_like(middle, large), middle, rest - middle], axis=1))
    return np.concatenate(rows) if rows else np.zeros((0, 3), int)


def fit_counts(found: np.ndarray, histogram: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradient: repeat counts of the patterns.

    Rows are weighted by length, as a long piece that is left over costs more room.
    """
    if not len(found):
        return np.zeros(0)
    size = len(histogram) - 1
    weight = 0.1 + np.arange(size + 1) / size
    weight[0] = 0
    scale = max(histogram.max(), 1)
    wanted, flat = histogram / scale * weight, found.ravel()
    part = weight[found]

    def apply(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, np.repeat(x, 3), size + 1) * weight

    # The largest eigenvalue, by power iteration, bounds the step.
    x = np.ones(len(found))
    for _ in range(20):
        x = (apply(x)[found] * part).sum(axis=1)
        norm = np.linalg.norm(x)
        x /= norm
    step = 1 / (norm * 1.05)
    counts = momentum = np.zeros(len(found))
    t = 1.0
    for _ in range(rounds):
        gradient = ((apply(momentum) - wanted)[found] * part).sum(axis=1)
        after = np.maximum(momentum - step * gradient, 0)
        t_after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        momentum = after + (t - 1) / t_after * (after - counts)
        if t > 50 and np.abs(after - counts).max() < 1e-9:
            counts = after
            break
        counts, t = after, t_after
    return counts * scale


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of the sequences that hold exactly the pieces of the histogram.

    `histogram[n]` counts the pieces of length n. Fitted patterns come first, then best fit on the rest.
    """
    size, left = len(histogram) - 1, histogram.astype(np.int64).copy()
    left[0] = 0
    groups: list[tuple[tuple[int, ...], int]] = []
    if left[size]:
        groups.append(((size,), int(left[size])))
        left[size] = 0
    found = patterns(size, np.flatnonzero(left))
    fitted = fit_counts(found, left)
    # Largest fits first, each rounded to the nearest whole number that the histogram still allows.
    for at in np.argsort(-fitted, kind="stable"):
        if fitted[at] < 0.5:
            break
        need = Counter(int(n) for n in found[at] if n)
        times = min([round(fitted[at]), *(int(left[n]) // k for n, k in need.items())])
        if times > 0:
            groups.append((tuple(int(n) for n in found[at] if n), times))
            for n, k in need.items():
                left[n] -= k * times
    groups += best_fit(left)
    return groups


def best_fit(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing on counts: sequences of equal room and content are placed together."""
    size = len(left) - 1
    rooms: dict[int, Counter] = {}
    for length in range(size, 0, -1):
        count = int(left[length])
        while count:
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                # A new sequence takes as many of this length as fit.
                each = min(size // length, count)
                times = count // each
                rooms.setdefault(size - each * length, Counter())[(length,) * each] += times
                count -= each * times
                continue
            content, times = rooms[room].popitem()
            each = min(room // length, count)
            used = min(times, count // each)
            if used < times:
                rooms[room][content] += times - used
            if not rooms[room]:
                del rooms[room]
            rooms.setdefault(room - each * length, Counter())[content + (length,) * each] += used
            count -= each * used
    return [(content, times) for contents in rooms.values() for content, times in contents.items()]


def slots(groups: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """length, first: numbers of that length from `first` on go to sequence + (number - first), at offset."""
    taken, sequence, rows = Counter(), 0, []
    for lengths, times in groups:
        offset = 0
        for length in lengths:
            rows.append((length, taken[length], sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "offset"]).sort_values(["length", "first"])


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, **options) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut_up = saved(pieces(docs, tokenizer, size, end, **options), "pieces")
    counted = cut_up.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(size + 1, np.int64)
    for row in counted.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `size` rows
        histogram[row["length"]] = row["n"]
    table = slots(plan(histogram))
    shared = docs.sparkSession.sparkContext.broadcast(
        {int(n): g[["first", "sequence", "offset"]].to_numpy(np.int64) for n, g in table.groupby("length")}
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(n).to_numpy() for n in ("length", "number"))
            number = number + batch.column("before").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                rows, own = np.flatnonzero(length == n), shared.value[int(n)]
                at = np.searchsorted(own[:, 0], number[rows], side="right") - 1
                sequence[rows] = own[at, 1] + number[rows] - own[at, 0]
                offset[rows] = own[at, 2]
            kept = [c for c in batch.schema.names if c not in ("number", "before")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"]
            )

    earlier = before_task(counted)
    fields = [f for f in cut_up.schema.fields if f.name not in ("task", "number")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"
    numbered = cut_up.join(earlier, ["task", "length"]).select(*(f.name for f in fields), "number", "before")
    return numbered.mapInArrow(place, schema)


def before_task(counted: DataFrame) -> DataFrame:
    """task, length, before: pieces of that length in the tasks before.

    Tasks are summed in blocks first, so that no window holds more than a block or the blocks of a length.
    """
    from pyspark.sql import Window

    block = 1024
    rows = counted.withColumn("block", (F.col("task") / block).cast("int"))
    within = Window.partitionBy("length", "block").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("length", "block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("length", "block", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("base"))
    inside = rows.select("task", "length", "block", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("inner"))
    return inside.join(blocks, ["length", "block"]).select("task", "length", (F.col("base") + F.col("inner")).alias("before"))

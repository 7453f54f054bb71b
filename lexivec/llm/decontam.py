"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The alphabet is the words of a text. Test strings are windows of ten consecutive item words; an item of
fewer words is one shorter window. Windows of one length share tables:

* the shift table tells, for a block of two words at the end of the current position, how far the search
  may move on without missing an occurrence (a block in no window: the window's length less one);
* where the shift is zero, the block's bucket is looked up by the window's first block, and the words
  between are compared directly.

Benchmark windows travel to the tasks in groups of items of bounded size; a benchmark over
`max_group_bytes` is searched in several passes, and hits of one document are merged.

Defined cases: null or wordless texts have no words and are clean; null or wordless items have no windows;
items with equal windows are all reported; a null item id is not reported but its windows count as hits.
Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.shared import same, saved

WINDOW = 10
GROUP_BYTES = 32 * 1024 * 1024
#: Lower-cases A-Z and turns every other ASCII character but digits and a-z into a blank.
TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256)
)


def split_words(text: str | None) -> list[bytes]:
    return text.encode().translate(TABLE).split() if text else []


def windows(words: list[bytes], size: int = WINDOW) -> set[tuple[bytes, ...]]:
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


class Tables:
    """Shift table and suffix buckets of windows of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], frozenset[int]], length: int):
        self.length, self.block = length, min(2, length)
        self.default = length - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = defaultdict(dict)
        for pattern in patterns:
            for end in range(self.block, length + 1):
                block = pattern[end - self.block : end] if self.block > 1 else pattern[end - 1]
                self.shift[block] = min(self.shift.get(block, self.default), length - end)
            last = pattern[-self.block :] if self.block > 1 else pattern[-1]
            self.bucket[last].setdefault(pattern[: self.block], []).append(pattern)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """Start and window of every occurrence."""
        length, n, shift, default = self.length, len(words), self.shift.get, self.default
        at = length - 1
        if self.block == 1:
            for i, word in enumerate(words):
                if word in self.shift:
                    yield i, (word,)
            return
        while at < n:
            block = (words[at - 1], words[at])
            move = shift(block, default)
            if move:
                at += move
                continue
            start = at - length + 1
            for pattern in self.bucket[block].get((words[start], words[start + 1]), ()):
                if tuple(words[start : at + 1]) == pattern:
                    yield start, pattern
            at += 1


class Matcher:
    """All windows of a group of items."""

    def __init__(self, items: list[tuple[object, str | None]], size: int = WINDOW):
        owners: dict[int, dict] = defaultdict(lambda: defaultdict(set))
        for number, (_, text) in enumerate(items):
            for window in windows(split_words(text), size):
                owners[len(window)][window].add(number)
        self.names = [None if name is None else str(name) for name, _ in items]
        self.owners = {k: {w: frozenset(v) for w, v in d.items()} for k, d in owners.items()}
        self.tables = [Tables(d, k) for k, d in self.owners.items()]

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
        """Merged spans of hit words (end exclusive), and the items, sorted as strings."""
        spans, items = [], set()
        for table in self.tables:
            owner = self.owners[table.length]
            for start, window in table.search(words):
                spans.append((start, start + table.length))
                items |= owner[window]
        return merged(spans), sorted({self.names[i] for i in items} - {None})


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


SCHEMA = "text_hash long, row long, doc_id long, n_words long, spans array<struct<start: int, end: int>>, items array<string>"


def _scan(docs: DataFrame, items: list[tuple[object, str | None]], size: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, size)
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                words = split_words(value.as_py())
                spans, found = matcher.find(words)
                rows.append((len(words), [{"start": a, "end": b} for a, b in spans], found))
            counts, spans, found = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("text_hash"),
                    batch.column("row"),
                    batch.column("doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    pa.array(found, pa.list_(pa.string())),
                ],
                names=["text_hash", "row", "doc_id", "n_words", "spans", "items"],
            )

    return docs.mapInArrow(run, SCHEMA)


def _groups(benchmark: DataFrame, item_id: str, text: str, max_bytes: int) -> Iterator[list[tuple[object, str | None]]]:
    """Items in groups of bounded size, one at a time on the driver."""
    group, size = [], 0
    for row in benchmark.select(F.col(item_id), F.col(text)).toLocalIterator():
        weight = len(row[1] or "") * WINDOW  # a text's words stand in up to ten windows
        if group and size + weight > max_bytes:
            yield group
            group, size = [], 0
        group.append((row[0], row[1]))
        size += weight
    yield group


def contaminated_spans(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id",
    item_id: str = "item_id", item_text: str = "text", max_group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """One row per document: doc_id, n_words, spans of hit words, items with occurring windows."""
    return _row_spans(docs, benchmark, window, text, doc_id, item_id, item_text, max_group_bytes).drop("text_hash")


def _row_spans(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id",
    item_id: str = "item_id", item_text: str = "text", max_group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """`contaminated_spans` with the hash of each row's text."""
    narrow = docs.select(
        F.xxhash64(text).alias("text_hash"), F.xxhash64(doc_id, text).alias("row"),
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
    )
    groups = _groups(benchmark, item_id, item_text, max_group_bytes)
    first, second = next(groups), next(groups, None)
    if second is None:
        return _scan(narrow, first, window).drop("row")
    # Rows that repeat id and text are told apart by their number among equals, so that each stays one row.
    passes = [saved(_scan(narrow, group, window), "scan") for group in (first, second)]
    passes += [saved(_scan(narrow, group, window), "scan") for group in groups]
    return _merge(passes)


def _merge(passes: list[DataFrame]) -> DataFrame:
    """Hits of several passes per document; a repeated row stays repeated."""
    copies = passes[0].groupBy("text_hash", "row", "doc_id", "n_words").agg(F.count(F.lit(1)).alias("copies"))
    hits = passes[0]
    for more in passes[1:]:
        hits = hits.union(more)
    keys = [F.col("row"), F.coalesce("doc_id", F.lit(0)).alias("id")]
    spans = hits.select(*keys, F.explode("spans").alias("s")).groupBy("row", "id").agg(F.collect_set("s").alias("spans"))
    items = hits.select(*keys, F.explode("items").alias("i")).groupBy("row", "id").agg(F.collect_set("i").alias("items"))
    copies = copies.withColumn("id", F.coalesce("doc_id", F.lit(0)))
    joined = copies.join(spans, ["row", "id"], "left").join(items, ["row", "id"], "left")
    none = F.array().cast("array<struct<start: int, end: int>>")
    repeated = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(
        "text_hash",
        "doc_id",
        "n_words",
        _union_spans(F.coalesce("spans", none)).alias("spans"),
        F.array_sort(F.coalesce("items", F.array().cast("array<string>"))).alias("items"),
    )


def _union_spans(spans):
    """Sorted spans with overlaps joined; only where a benchmark needs several passes."""

    def union(spans):
        return [{"start": a, "end": b} for a, b in merged([(s["start"], s["end"]) for s in spans])]

    return F.udf(union, "array<struct<start: int, end: int>>", useArrow=True)(spans)


def hit_words(spans) -> object:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", by_row: bool = False, **options) -> DataFrame:
    """The documents without any occurring window, in the columns of `docs`.

    By row, every row is judged by its own text. Otherwise the rows of one id are one document, and a hit in one
    of them drops all; rows without an id are always judged one by one.
    """
    hits = _row_spans(docs, benchmark, text=text, doc_id=doc_id, **options).filter(F.size("spans") > 0)
    # The hash is left out where the id alone decides.
    of_text = (lambda i, h: h) if by_row else (lambda i, h: F.when(i.isNull(), h))
    gone = hits.select(F.col("doc_id").alias("_d_id"), of_text(F.col("doc_id"), F.col("text_hash")).alias("_d_hash")).distinct()
    key = F.col(doc_id).cast("long")
    found = same(key, F.col("_d_id")) & same(of_text(key, F.xxhash64(text)), F.col("_d_hash"))
    return docs.join(gone, found, "left_anti")


def sha256(values: list[str]) -> str:
    return hashlib.sha256(",".join(values).encode()).hexdigest()

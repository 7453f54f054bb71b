"""JSON arrays and quoted CSV read by many tasks: files are cut by bytes, and each cut learns where it lies.

A byte range alone cannot tell whether it begins inside quotes. So a first pass
notes, for each state in which a range may begin, the state in which it ends and
how far the nesting rises. These transitions are composed along each file, which
gives every range its true beginning; a second pass cuts the records that begin
in it. A record that runs over the end of its range is read on to its end.
"""

from __future__ import annotations

import csv
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivec.scale import MAX_PARTITIONS, materialise
from lexivec.sources.tables import CORPUS, SERIES

RANGE_BYTES = 32 * 1024 * 1024
# What is read at a time; past the end of a smaller range no more than its size, of a long record as much again as is held of it.
BLOCK = 1024 * 1024
# Bytes of records in one Arrow batch.
BATCH_BYTES = 8 * 1024 * 1024

# Where a range may begin: outside quotes, inside, or inside after a backslash.
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
QUOTE, BACKSLASH, NEWLINE = 34, 92, 10
BRACKETS = np.frombuffer(b"[]{}", np.uint8)
MARK = b"\xef\xbb\xbf"

# Gives so many bytes from a place of a file.
Read = Callable[[int, int], bytes]


def _opened(path: str):
    """The file of a path as Spark names it, on any file system that Arrow reaches (local, HDFS, S3, GCS)."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def _reader(file) -> Read:
    def read(at: int, size: int) -> bytes:
        file.seek(at)
        return file.read(size)

    return read


def _structure(data: np.ndarray, state: int, escapes: bool) -> tuple[np.ndarray, int]:
    """Which bytes lie outside quotes (quotes themselves do not count), and the state after the last byte."""
    quotes = data == QUOTE
    last_escapes = False
    if escapes:
        slash = data == BACKSLASH
        if state == ESCAPED and len(data):
            slash[0] = quotes[0] = False
        places = np.arange(len(data))
        # The run of backslashes before a byte escapes it where its length is odd.
        plain = np.maximum.accumulate(np.where(slash, -1, places)) if len(data) else places
        run = places - plain
        before = np.concatenate([[0], run[:-1]]) if len(data) else run
        quotes &= before % 2 == 0
        last_escapes = bool(len(data)) and bool(run[-1] % 2)
    inside = np.bitwise_xor.accumulate(np.concatenate([[state != OUTSIDE], quotes]))
    end = OUTSIDE if not inside[-1] else ESCAPED if last_escapes or (state == ESCAPED and not len(data)) else INSIDE
    return ~(inside[:-1] | inside[1:]), end


def _nesting(data: np.ndarray, outside: np.ndarray) -> np.ndarray:
    """+1 at an opening bracket, -1 at a closing one."""
    opening, closing = (data == ord("[")) | (data == ord("{")), (data == ord("]")) | (data == ord("}"))
    return np.where(outside & opening, 1, 0) - np.where(outside & closing, 1, 0)


def _transitions(read: Read, start: int, end: int, json: bool) -> list[list[int]]:
    """For each state in which a range may begin: the state after it, and by how much the nesting rises."""
    found = [[state, 0] for state in ((OUTSIDE, INSIDE, ESCAPED) if json else (OUTSIDE, INSIDE))]
    for at in range(start, end, BLOCK):
        values = np.frombuffer(read(at, min(BLOCK, end - at)), np.uint8)
        # Different beginnings soon meet in the same states.
        steps = {state: _structure(values, state, json) for state in {state for state, _ in found}}
        rises = {state: int(_nesting(values, outside).sum()) if json else 0 for state, (outside, _) in steps.items()}
        found = [[steps[state][1], rise + rises[state]] for state, rise in found]
    return found


def _json_records(read: Read, start: int, end: int, state: int, depth: int) -> Iterator[bytes]:
    """The objects of the outer array that begin in `start..end`."""
    at, kept, opened = start, b"", None
    while at < end or opened is not None:
        data = read(at, min(BLOCK, end - at) if at < end else max(min(BLOCK, end - start), len(kept)))
        if not data:
            raise ValueError("a JSON record has no end")
        values = np.frombuffer(data, np.uint8)
        outside, state = _structure(values, state, True)
        levels = depth + np.cumsum(_nesting(values, outside))
        brackets = np.flatnonzero(outside & np.isin(values, BRACKETS))
        if start == at == 0 and (not len(brackets) or data[brackets[0]] != ord("[")):
            raise ValueError("the file does not begin with a JSON array")
        # `held` begins at place `base` of the file.
        held, base = (kept + data, opened) if opened is not None else (data, at)
        begins = (values[brackets] == ord("{")) & (levels[brackets] == 2)
        ends = (values[brackets] == ord("}")) & (levels[brackets] == 1)
        for i in brackets[begins | ends].tolist():
            if data[i] == ord("{"):
                if at + i >= end:
                    return
                opened = at + i
            elif opened is not None:
                yield held[opened - base : at + i + 1 - base]
                opened = None
        kept = held[opened - base :] if opened is not None else b""
        depth, at = int(levels[-1]), at + len(data)


def _csv_records(read: Read, start: int, end: int, state: int, depth: int) -> Iterator[bytes]:
    """The records that begin in `start..end`: at the start of the file, or after a line break outside quotes."""
    at, kept = start, b""
    begun = start == 0 or (state == OUTSIDE and read(start - 1, 1) == b"\n")
    while begun or at < end:
        data = read(at, min(BLOCK, end - at) if at < end else max(min(BLOCK, end - start), len(kept)))
        if not data:
            if kept:
                yield kept
            return
        values = np.frombuffer(data, np.uint8)
        outside, state = _structure(values, state, False)
        done = 0
        for i in np.flatnonzero(outside & (values == NEWLINE)).tolist():
            if begun:
                yield kept + data[done:i]
            begun, kept, done = True, b"", i + 1
            if at + done >= end:
                return
        if begun:
            kept += data[done:]
        at += len(data)


def _after_header(records: Iterator[bytes], names: list[str], first: bool) -> Iterator[bytes]:
    """Records without line ends and empty lines; the first one of a file must hold the names of the columns."""
    for n, record in enumerate(records):
        record = record.removesuffix(b"\r")
        if first and n == 0:
            given = next(csv.reader([record.removeprefix(MARK).decode()]), [])
            if given != names:
                raise ValueError(f"the columns of the file are {given}, not {names}")
        elif record:
            yield record


RANGES = "path string, length long, start long, stop long"


def byte_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """`(path, length, start, stop)` of every range of the files at `path`; no content is read."""
    if range_bytes < 1:
        raise ValueError("range_bytes must be at least 1")
    # Only names and sizes are selected, so the files are listed and not opened.
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter(F.col("length") > 0)
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))
    ranges = files.withColumn("start", F.explode(starts))
    return ranges.withColumn("stop", F.least(F.col("length"), F.col("start") + range_bytes))


def _spread(ranges: DataFrame) -> DataFrame:
    """Ranges spread over tasks, small ones together until a task has `RANGE_BYTES`."""
    number, size = ranges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0))).first()
    least = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(max(1, min(number, max(least, math.ceil(size / RANGE_BYTES)), MAX_PARTITIONS)), "path", "start")


def located_ranges(spark: SparkSession, path: str, json: bool, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The ranges with the state and the nesting in which each begins."""

    def note(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                with _opened(row.path) as file:
                    found.append(_transitions(_reader(file), row.start, row.stop, json))
            yield batch.assign(ends=found)

    def compose(ranges: pd.DataFrame) -> pd.DataFrame:
        ranges, state, depth, begins = ranges.sort_values("start"), OUTSIDE, 0, []
        for ends in ranges["ends"]:
            begins.append((state, depth))
            state, rise = int(ends[state][0]), int(ends[state][1])
            depth += rise
        if state != OUTSIDE or depth != 0:
            raise ValueError(f"quotes or brackets are left open at the end of {ranges['path'].iloc[0]}")
        return ranges.drop(columns="ends").assign(state=[s for s, _ in begins], depth=[d for _, d in begins])

    ranges = byte_ranges(spark, path, range_bytes)
    noted = _spread(ranges).mapInPandas(note, f"{RANGES}, ends array<array<long>>")
    # A group is the ranges of one file: a few numbers for every `range_bytes` of it.
    located = noted.groupBy("path").applyInPandas(compose, f"{RANGES}, state int, depth long")
    return materialise(located, "ranges")


def split_records(
    spark: SparkSession, path: str, header: list[str] | None = None, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """The text of every record, in a column `record`: of JSON arrays, or, with a header, of CSV files."""
    located = located_ranges(spark, path, header is None, range_bytes)
    arrow = pa.schema([("record", pa.string())])

    def batch_of(held: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held, pa.binary()).cast(pa.string())], schema=arrow)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                place = row["start"], row["stop"], row["state"], row["depth"]
                with _opened(row["path"]) as file:
                    if header is None:
                        found = _json_records(_reader(file), *place)
                    else:
                        found = _after_header(_csv_records(_reader(file), *place), header, row["start"] == 0)
                    held, size = [], 0
                    for record in found:
                        held.append(record)
                        size += len(record)
                        if size > BATCH_BYTES:
                            yield batch_of(held)
                            held, size = [], 0
                    if held:
                        yield batch_of(held)

    return _spread(located).mapInArrow(cut, "record string")


def read_corpus_split(
    spark: SparkSession, path: str, schema: T.StructType = CORPUS, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Corpus records of JSON arrays of objects in UTF-8, `range_bytes` of a file to a task.

    The rows are those of `read_corpus`, which gives a whole file to one task. A
    file that is no array, an object that does not fit the schema, and quotes or
    brackets that stay open are errors; members of the array that are no objects
    are left out, and an empty file has no rows. A task holds a block of 1 MB, a batch of records and the
    longest record. On a cluster the files must lie where Arrow reaches them from the tasks.
    """
    parsed = F.from_json("record", schema, {"mode": "FAILFAST"})
    return split_records(spark, path, None, range_bytes).select(parsed.alias("r")).select("r.*")


def read_series_split(
    spark: SparkSession, path: str, schema: T.StructType = SERIES, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """The series table of CSV files in UTF-8 with header and quoted line breaks, `range_bytes` of a file to a task.

    The rows are those of `read_series`. Quotes enclose whole values, and a quote
    inside one is doubled; a lone quote in an unquoted value is not told apart from an
    opening one. The header must name the columns of the schema in order.
    """
    options = {"mode": "FAILFAST", "escape": '"', "maxCharsPerColumn": "-1"}
    parsed = F.from_csv("record", schema.toDDL(), options)
    return split_records(spark, path, schema.fieldNames(), range_bytes).select(parsed.alias("r")).select("r.*")

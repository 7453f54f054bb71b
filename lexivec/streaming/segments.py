"""Documents that arrive and are withdrawn, kept as segments that are merged as they grow.

Every batch becomes a segment of its own: counted postings, documents, the ids it withdraws, and a Bloom filter of its
ids. When a level holds `fanout` segments they are merged into one of the next level, so a search opens a number of
segments that grows with the logarithm of the batches, and a document is rewritten once a level. A segment never
changes. The manifest names the live ones; it is written last, in one of two places by turns, so what a reader finds
is always whole, and a batch that fails leaves nothing but an unnamed folder.

Whether an id is present is asked of the filters: one row of 256 bits for every 16 ids, of which an id sets four bits.
Only ids that a filter may hold are looked up in the documents of that segment; a segment without one is not opened.

A withdrawal removes the document of that id from all earlier batches. In a batch, withdrawals go first, so a document
that is withdrawn and brought again is replaced. A merge drops what is withdrawn inside it, and the withdrawals
themselves once nothing older is left.
"""

from __future__ import annotations

import json
import math
import posixpath
import uuid
from collections.abc import Sequence
from contextlib import ExitStack
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lexivec.operators.bm25 import TEXT_BYTES, BM25Config, Index, corpus_totals, doc_lengths, precision_of, term_freq, term_stats
from lexivec.operators.checks import require_columns
from lexivec.scale import MAX_PARTITIONS, PARTITION_BYTES, borrowed, is_small, materialise, scan_bytes, write_table
from lexivec.streaming.ingest import NO_ID, PRESENT, REPEATED, _settings

FANOUT = 4
#: Words of a filter row, and ids for which there is one.
WORDS_OF_ROW, IDS_OF_ROW = 4, 16
EMPTY = {"number": -1, "batch": -1, "segments": [], "settings": None, "last": {}}


def read_manifest(spark: SparkSession, path: str) -> dict:
    """What is live: `segments` (oldest first, each with folder, level, first and last batch, documents, withdrawn),
    the last `batch`, and what adding it took."""
    found = []
    for place in range(2):
        try:
            found += spark.read.schema("number long, manifest string").parquet(posixpath.join(path, f"manifest-{place}")).collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return json.loads(max(found, key=lambda r: r["number"])["manifest"]) if found else EMPTY


def _commit(spark: SparkSession, path: str, manifest: dict) -> None:
    number = manifest["number"] + 1
    row = spark.range(1).select(F.lit(number).cast("long").alias("number"), F.lit(json.dumps({**manifest, "number": number})).alias("manifest"))
    row.coalesce(1).write.mode("overwrite").parquet(posixpath.join(path, f"manifest-{number % 2}"))


def _table(spark: SparkSession, path: str, segments: Sequence[dict], name: str) -> DataFrame | None:
    """A table of these segments, with the folder of each row's segment; nothing where there is no segment."""
    tables = [
        spark.read.parquet(posixpath.join(path, "segments", s["folder"], name)).withColumn("_segment", F.lit(s["folder"])) for s in segments
    ]
    return reduce(DataFrame.unionByName, tables) if tables else None


def _in_files(df: DataFrame, size: int, *columns: str) -> DataFrame:
    """`df` in as many parts as `size` bytes fill, which become files."""
    return df.repartition(min(max(math.ceil(size / PARTITION_BYTES), 1), MAX_PARTITIONS), *columns)


def _row_of(doc_id: str, rows: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(rows))


def _bits_of(doc_id: str) -> list[Column]:
    """The bit that an id sets in each word of its row."""
    seed = F.xxhash64(F.lit("bits"), F.col(doc_id))
    shift = [F.shiftrightunsigned(seed, 6 * k).bitwiseAND(F.lit(63)).cast("int") for k in range(WORDS_OF_ROW)]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), s) for s in shift]


def _filter_rows(documents: int) -> int:
    return max(1, math.ceil(documents / IDS_OF_ROW))


def _sketch(documents: DataFrame, rows: int) -> DataFrame:
    words = [F.bit_or(bit).alias(f"word_{k}") for k, bit in enumerate(_bits_of("doc_id"))]
    return documents.groupBy(_row_of("doc_id", rows).alias("row")).agg(*words)


def _write_segment(
    spark: SparkSession, path: str, postings: DataFrame, documents: DataFrame, withdrawn: DataFrame, size: int, level: int, first: int, last: int,
    laid: bool = False,
) -> dict:
    """Write the tables of a segment; `documents` and `postings` have the batch that brought them.

    Postings that are `laid` by document already become files as they lie.
    """
    folder = uuid.uuid4().hex

    def at(name: str) -> str:
        return posixpath.join(path, "segments", folder, name)

    placed = postings if laid else _in_files(postings, size, "doc_id")
    write_table(placed.sortWithinPartitions("term", "doc_id"), at("postings"))
    write_table(_in_files(documents, size // 8, "doc_id").sortWithinPartitions("doc_id"), at("documents"))
    write_table(_in_files(withdrawn, size // 8, "doc_id"), at("withdrawn"))
    kept = spark.read.schema(documents.schema).parquet(at("documents"))
    counts = {"documents": kept.count(), "withdrawn": spark.read.schema(withdrawn.schema).parquet(at("withdrawn")).count()}
    rows = _filter_rows(counts["documents"])
    write_table(_in_files(_sketch(kept.select("doc_id"), rows), size // 64, "row").sortWithinPartitions("row"), at("sketch"))
    return {"folder": folder, "level": level, "first": first, "last": last, "rows": rows, **counts}


def _may_hold(spark: SparkSession, path: str, segments: Sequence[dict], ids: DataFrame) -> DataFrame | None:
    """`(doc_id, _segment)`: the ids that the filter of a segment does not rule out."""
    sketch = _table(spark, path, segments, "sketch")
    if sketch is None:
        return None
    named = F.explode(F.array(*(F.struct(F.lit(s["folder"]).alias("_segment"), F.lit(s["rows"]).cast("long").alias("rows")) for s in segments)))
    asked = ids.withColumn("_s", named).select("doc_id", "_s.*").withColumn("row", F.pmod(F.xxhash64("doc_id"), F.col("rows"))).drop("rows")
    asked = F.broadcast(asked) if is_small(asked) else asked
    met = sketch.join(asked, ["_segment", "row"])
    held = reduce(lambda a, b: a & b, (F.col(f"word_{k}").bitwiseAND(bit) != 0 for k, bit in enumerate(_bits_of("doc_id"))))
    return met.filter(held).select("doc_id", "_segment")


def _present(spark: SparkSession, path: str, manifest: dict, ids: DataFrame) -> tuple[DataFrame | None, dict]:
    """`(doc_id)`: which of the distinct `ids` are live, and what it took to know."""
    segments = [s for s in manifest["segments"] if s["documents"]]
    maybe = _may_hold(spark, path, segments, ids)
    if maybe is None:
        return None, {"possible": 0, "opened": 0}
    maybe = materialise(maybe, "possible")
    per = {r["_segment"]: r["count"] for r in maybe.groupBy("_segment").count().collect()}  # a row a segment
    opened = [s for s in segments if s["folder"] in per]
    work = {"possible": sum(per.values()), "opened": len(opened)}
    if not opened:
        return None, work
    wanted = maybe.select("doc_id").distinct()
    wanted = F.broadcast(wanted) if is_small(wanted) else wanted
    found = _table(spark, path, opened, "documents").select("doc_id", "batch").join(wanted, "doc_id", "left_semi")
    return _live(spark, path, manifest, found, wanted).select("doc_id").distinct(), work


def _live(spark: SparkSession, path: str, manifest: dict, rows: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """`rows(doc_id, batch, ...)` without those that a later batch withdrew."""
    withdrawn = _table(spark, path, [s for s in manifest["segments"] if s["withdrawn"]], "withdrawn")
    return rows if withdrawn is None else _without(rows, withdrawn if wanted is None else withdrawn.join(wanted, "doc_id", "left_semi"))


def _without(rows: DataFrame, withdrawn: DataFrame) -> DataFrame:
    last = withdrawn.groupBy("doc_id").agg(F.max("batch").alias("_until"))
    last = F.broadcast(last) if is_small(last) else last
    joined = rows.join(last, "doc_id", "left").filter(F.col("_until").isNull() | (F.col("batch") >= F.col("_until")))
    return joined.drop("_until")


def _merged(spark: SparkSession, path: str, segments: list[dict], fanout: int) -> list[dict]:
    """The segments after all merges that are due: of the `fanout` newest of one level each."""
    while len(segments) >= fanout and len({s["level"] for s in segments[-fanout:]}) == 1:
        kept, due = segments[:-fanout], segments[-fanout:]
        postings, documents, withdrawn = (_table(spark, path, due, n).drop("_segment") for n in ("postings", "documents", "withdrawn"))
        size = scan_bytes(postings)
        if any(s["withdrawn"] for s in due):
            postings, documents = _without(postings, withdrawn), _without(documents, withdrawn)
        # A withdrawal is needed as long as there is something older.
        needed = withdrawn.groupBy("doc_id").agg(F.max("batch").alias("batch")) if kept else withdrawn.limit(0)
        level, first, last = due[0]["level"] + 1, due[0]["first"], due[-1]["last"]
        segments = [*kept, _write_segment(spark, path, postings, documents, needed, size, level, first, last)]
    return segments


def add_batch(
    batch: DataFrame, batch_id: int, config: BM25Config, path: str, id_col: str = "doc_id", withdraw_col: str | None = None,
    refuse: str = "record", fanout: int = FANOUT,
) -> None:
    """Add one batch to the segments at `path`; a batch that has been added already is left alone."""
    spark = batch.sparkSession
    manifest = read_manifest(spark, path)
    if batch_id <= manifest["batch"]:
        return
    columns = list(dict.fromkeys([id_col, *config.field_weights, *config.retained]))
    leaves = F.lit(False) if withdraw_col is None else F.coalesce(F.col(withdraw_col), F.lit(False))
    with ExitStack() as until_added:
        with borrowed(batch.select(*columns, leaves.alias("_leaves")), "batch") as batch:
            named = batch.filter(F.col(id_col).isNotNull())
            going = named.filter("_leaves").select(F.col(id_col).alias("doc_id")).distinct().withColumn("batch", F.lit(batch_id).cast("long"))
            going = until_added.enter_context(borrowed(going, "withdrawn"))
            # The smallest row of an id is taken, so a retried batch takes the same one.
            order = Window.partitionBy(id_col).orderBy(*(F.col(c) for c in columns))
            numbered = named.filter("NOT _leaves").withColumn("_nth", F.row_number().over(order))
            judged = numbered.withColumn("reason", F.when(F.col("_nth") > 1, F.lit(REPEATED))).drop("_nth")
            staying = named.filter("NOT _leaves").select(F.col(id_col).alias("doc_id")).distinct().join(going.select("doc_id"), "doc_id", "left_anti")
            present, work = _present(spark, path, manifest, staying)
            if present is not None:
                known = present.select(F.col("doc_id").alias(id_col), F.lit(True).alias("_known"))
                judged = judged.join(known, id_col, "left")
                judged = judged.withColumn("reason", F.when(F.col("_known"), F.lit(PRESENT)).otherwise(F.col("reason"))).drop("_known")
            nameless = batch.filter(F.col(id_col).isNull()).withColumn("reason", F.lit(NO_ID))
            judged = until_added.enter_context(borrowed(judged.unionByName(nameless).drop("_leaves"), "judged"))
        refused = judged.filter(F.col("reason").isNotNull())
        if refuse == "fail":
            first = refused.first()
            if first is not None:
                raise ValueError(f"document {first[id_col]!r} of batch {batch_id} is refused: {first['reason']}")
        write_table(refused, posixpath.join(path, "rejected", f"batch={batch_id}"), mode="overwrite")
        arrived = judged.filter(F.col("reason").isNull()).drop("reason")
        size, number = scan_bytes(judged), F.lit(batch_id).cast("long").alias("batch")
        # Texts are moved and not their counts, which are several times as large.
        spread = arrived.repartition(min(max(math.ceil(size / TEXT_BYTES), 1), MAX_PARTITIONS), id_col)
        postings = term_freq(spread, config, id_col).select("*", number)
        documents = doc_lengths(arrived, config, id_col).select("*", number)
        made = _write_segment(spark, path, postings, documents, going, size, 0, batch_id, batch_id, laid=True)
        segments = _merged(spark, path, [*manifest["segments"], made], fanout)
    _commit(spark, path, {**manifest, "batch": batch_id, "segments": segments, "settings": _settings(config), "last": work})


def ingest_segments(
    documents: DataFrame, config: BM25Config, path: str, checkpoint: str, id_col: str = "doc_id", withdraw_col: str | None = None,
    refuse: str = "record", first_batch: int = 0, fanout: int = FANOUT,
) -> DataStreamWriter:
    """A stream writer that adds each batch to the segments at `path`; start it with `.start()`.

    Rows whose boolean `withdraw_col` is true withdraw their id. What is refused, and how, is as for `ingest`. One stream
    at a time may write to a path; batches are numbered from `first_batch`, and one that has been added is not added again.
    """
    if refuse not in ("record", "fail"):
        raise ValueError("refuse must be record or fail")
    if fanout < 2:
        raise ValueError("at least two segments are merged")
    _check_settings(read_manifest(documents.sparkSession, path), config, path)
    wanted = [id_col, *config.field_weights, *config.retained]
    require_columns(documents, wanted if withdraw_col is None else [*wanted, withdraw_col])
    return (
        documents.writeStream.foreachBatch(
            lambda batch, n: add_batch(batch, first_batch + n, config, path, id_col, withdraw_col, refuse, fanout)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )


def _check_settings(manifest: dict, config: BM25Config, path: str) -> None:
    if manifest["settings"] not in (None, _settings(config)):
        raise ValueError(f"the index at {path} was built with other field weights or retained fields")


def segmented_index(spark: SparkSession, config: BM25Config, path: str, precision: object = 4) -> Index:
    """The index over all documents that are live; statistics are counted from the segments."""
    manifest = read_manifest(spark, path)
    if not manifest["segments"]:
        raise ValueError(f"no documents have been added at {path}")
    _check_settings(manifest, config, path)
    postings, documents = (
        _live(spark, path, manifest, _table(spark, path, manifest["segments"], name)).drop("batch", "_segment") for name in ("postings", "documents")
    )
    totals = corpus_totals(documents)
    terms = term_stats(postings.select("term"), totals.select("documents").scalar(), config.k)
    return Index(config, precision_of(precision), postings, documents, terms, totals, occurrences=postings.select("term"))

"""BM25F keyword index and search.

Documents are shuffled once, by document id, as raw text. Term counts, lengths and
the per-document score sums are then all grouped by document and need no further
shuffle. What a search shuffles is the best `limit` rows per task and query.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivec.functions.prep import STEMMED_WORDS, Step, apply_steps
from lexivec.functions.scores import half_away_units
from lexivec.operators.checks import require_columns, require_documents
from lexivec.scale import (
    BROADCAST_BYTES,
    BROADCAST_ROWS,
    PARTITION_BYTES,
    fits,
    is_small,
    materialise,
    measure,
    partition_count,
    rank_all,
    scan_bytes,
    top_per_group,
)

# Parameter defaults, result limit and precision range.
DEFAULT_K1, DEFAULT_B, DEFAULT_K = 1.2, 0.75, 1.0
DEFAULT_LIMIT = 10
MIN_PRECISION, MAX_PRECISION = 4, 9

# A term that holds more than this share of all postings is split when joined on.
HOT_SHARE = 1.0 / 1000
HOT_FLOOR = 100_000

# Bytes of documents for a task: files of text hold several times as many bytes of counts.
TEXT_BYTES = PARTITION_BYTES // 4

# Bytes of counts that are laid out by term at a time, in so many steps at most unless there are very many terms.
SLICE_BYTES, SLICES = PARTITION_BYTES // 8, 8

# Up to so many different query terms are listed in the filter of a stored index.
LISTED_TERMS = 1_000


def _number(value: object) -> float | None:
    try:
        number = float(value)
    except (TypeError, ValueError):
        return None
    return None if math.isnan(number) else number


def _in_range(value: object, low: float, high: float, default: float) -> float:
    number = _number(value)
    return default if number is None or not low <= number <= high else number


def precision_of(value: object) -> int:
    """Decimal places of stored weights: 4 to 9, and 4 for anything that is no number."""
    number = _number(value)
    if number is None or math.isinf(number):
        return MIN_PRECISION
    return min(max(int(number), MIN_PRECISION), MAX_PRECISION)


@dataclass(frozen=True)
class BM25Config:
    """Field weights, parameters, retained fields and text preparation.

    Weights are numbers other than zero; a negative one makes its field count
    against a document. Parameters out of range take their defaults. `field_prep`
    overrides `prep` by field; its key `search` is for query texts.
    """

    field_weights: Mapping[str, float]
    k1: float = DEFAULT_K1
    b: float = DEFAULT_B
    k: float = DEFAULT_K
    retained: Sequence[str] = ()
    prep: Sequence[Step] = STEMMED_WORDS
    field_prep: Mapping[str, Sequence[Step]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not isinstance(self.field_weights, Mapping) or not self.field_weights:
            raise ValueError("field weights must name at least one field")
        weights = {}
        for name, value in self.field_weights.items():
            number = _number(value)
            if not number:
                raise ValueError(f"the weight of field {name!r} must be a number other than 0, not {value!r}")
            weights[name] = number
        if isinstance(self.retained, str) or not all(isinstance(f, str) and f for f in self.retained):
            raise ValueError("retained fields must be a list of non-empty names")
        for name, steps in {"": self.prep, **self.field_prep}.items():
            if not isinstance(steps, Sequence) or not all(callable(s) for s in steps):
                raise ValueError(f"text preparation must be a list of functions, but is not for {name or 'prep'!r}")
            if name and name != "search" and name not in weights:
                raise ValueError(f"text preparation is given for {name!r}, which is no weighted field")
        keep = object.__setattr__
        keep(self, "field_weights", weights)
        keep(self, "b", _in_range(self.b, 0.0, 1.0, DEFAULT_B))
        keep(self, "k1", _in_range(self.k1, 0.0, math.inf, DEFAULT_K1))
        keep(self, "k", _in_range(self.k, 0.0, math.inf, DEFAULT_K))
        keep(self, "retained", tuple(self.retained))

    def steps(self, name: str) -> Sequence[Step]:
        return self.field_prep.get(name, self.prep)

    def tokens(self, text: Column, name: str) -> Column:
        return apply_steps(text, self.steps(name))


def bucket_of(term: Column, buckets: int) -> Column:
    """Which part of a stored index holds a term."""
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Index:
    """A keyword index as tables.

    `postings(doc_id, term, freq, length)`, `documents(doc_id, length, retained...)`,
    `terms(term, df, idf)` and the one-row `totals(documents, total_length, mean_length)`.
    An index that is not stored also has the tables it is counted from: `tokens`, one
    row per token, and `occurrences(term)`, one row per term and document.
    A stored index is laid out in `buckets` of terms, of which a search reads those it needs.
    """

    config: BM25Config
    precision: int
    postings: DataFrame
    documents: DataFrame
    terms: DataFrame
    totals: DataFrame
    tokens: DataFrame | None = None
    occurrences: DataFrame | None = None
    buckets: int | None = None

    @property
    def stored_weights(self) -> bool:
        """Whether postings hold their weight, in `units`."""
        return "units" in self.postings.columns

    def known_postings(
        self, used: DataFrame, buckets: Sequence[int] | None = None, listed: Sequence[str] | None = None
    ) -> DataFrame:
        """Postings of the terms in a small table `used(term)`, which lie in these buckets.

        While an index is not yet stored, only the tokens of these terms are counted.
        Terms that are listed one by one are looked for in the files.
        """
        if self.tokens is None:
            found = self._in_buckets(self.postings, buckets)
            return found if listed is None else found.filter(F.col("term").isin(list(listed)))
        return _counts_of(self.tokens.join(F.broadcast(used), "term", "left_semi"), self.config)

    def known_terms(self, used: DataFrame, buckets: Sequence[int] | None = None) -> DataFrame:
        """Statistics of the terms in a small table `used(term)`, which lie in these buckets.

        While an index is not yet stored, only these terms are counted.
        """
        if self.occurrences is None:
            return self._in_buckets(self.terms, buckets).join(F.broadcast(used), "term", "left_semi")
        seen = self.occurrences.join(F.broadcast(used), "term", "left_semi")
        return term_stats(seen, self.total("documents"), self.config.k)

    def _in_buckets(self, table: DataFrame, buckets: Sequence[int] | None) -> DataFrame:
        if buckets is None or len(buckets) == self.buckets:
            return table
        return table.filter(F.col("bucket").isin(list(buckets)))

    @property
    def idf(self) -> DataFrame:
        return self.terms.select("term", "idf")

    @property
    def retained(self) -> DataFrame:
        return self.documents.select("doc_id", *self.config.retained)

    def total(self, name: str) -> Column:
        """One of the corpus totals, as a scalar subquery."""
        return self.totals.select(name).scalar()

    def stats(self) -> DataFrame:
        """Corpus totals with the number of distinct terms, in one row."""
        return self.terms.agg(F.count(F.lit(1)).alias("terms")).select(
            "terms",
            self.total("documents").alias("documents"),
            self.total("total_length").alias("total_length"),
            self.total("mean_length").alias("mean_length"),
        )


def _token_arrays(docs: DataFrame, config: BM25Config, id_col: str) -> DataFrame:
    """`doc_id`, retained fields, one token array per weighted field and the weighted length, one row per document."""
    arrays = {f"_tokens_{i}": config.tokens(F.col(name), name) for i, name in enumerate(config.field_weights)}
    prepared = docs.select(F.col(id_col).alias("doc_id"), *config.retained, *(c.alias(n) for n, c in arrays.items()))
    for name in arrays:
        if prepared.schema[name].dataType != T.ArrayType(T.StringType()):
            found = prepared.schema[name].dataType.simpleString()
            raise TypeError(f"text preparation must end in an array of strings, not {found}")
    sizes = [
        F.coalesce(F.size(f"_tokens_{i}"), F.lit(0)) * F.lit(abs(weight))
        for i, weight in enumerate(config.field_weights.values())
    ]
    return prepared.withColumn("length", sum(sizes[1:], sizes[0]).cast("double"))


def _tokens_of(prepared: DataFrame, config: BM25Config) -> DataFrame:
    """Every token of every weighted field: `(doc_id, length, field, term)`; `field` is its place in the config."""
    fields = len(config.field_weights)
    pairs = [c for i in range(fields) for c in (F.lit(i), F.col(f"_tokens_{i}"))]
    return (
        prepared.select("doc_id", "length", F.stack(F.lit(fields), *pairs).alias("field", "tokens"))
        .select("doc_id", "length", "field", F.explode("tokens").alias("term"))
        .filter(F.col("term").isNotNull())
    )


def _counts_of(tokens: DataFrame, config: BM25Config) -> DataFrame:
    # Counted per field and weighted afterwards, so `freq` does not depend on the order of rows.
    counts = {f"_n_{i}": F.count_if(F.col("field") == i) for i in range(len(config.field_weights))}
    freq = [F.col(n) * F.lit(w) for n, w in zip(counts, config.field_weights.values(), strict=True)]
    return (
        tokens.groupBy("doc_id", "length", "term")
        .agg(*(c.alias(n) for n, c in counts.items()))
        .select("doc_id", "term", sum(freq[1:], freq[0]).cast("double").alias("freq"), "length")
    )


def _lengths_of(prepared: DataFrame, config: BM25Config) -> DataFrame:
    return prepared.select("doc_id", "length", *config.retained)


def _distinct_terms(config: BM25Config) -> Column:
    """The terms of a document in the order they are first seen."""
    arrays = [F.coalesce(f"_tokens_{i}", F.array().cast("array<string>")) for i in range(len(config.field_weights))]
    return F.array_distinct(F.concat(*arrays))


def _occurrences_of(prepared: DataFrame, config: BM25Config) -> DataFrame:
    return prepared.select(F.explode(_distinct_terms(config)).alias("term")).filter(F.col("term").isNotNull())


def term_freq(docs: DataFrame, config: BM25Config, id_col: str = "doc_id") -> DataFrame:
    """Weighted frequency of each term in each document, all fields merged: `(doc_id, term, freq, length)`."""
    return _counts_of(_tokens_of(_token_arrays(docs, config, id_col), config), config)


def doc_lengths(docs: DataFrame, config: BM25Config, id_col: str = "doc_id") -> DataFrame:
    """Weighted length and retained fields of every document; a document without tokens has length 0."""
    return _lengths_of(_token_arrays(docs, config, id_col), config)


def term_occurrences(docs: DataFrame, config: BM25Config, id_col: str = "doc_id") -> DataFrame:
    """One row `(term)` per term and document."""
    return _occurrences_of(_token_arrays(docs, config, id_col), config)


def corpus_totals(documents: DataFrame) -> DataFrame:
    """Number of documents, total and mean length, in one row."""
    return documents.agg(
        F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("length"), F.lit(0.0)).alias("total_length")
    ).withColumn("mean_length", F.try_divide("total_length", "documents"))


def doc_freq(occurrences: DataFrame) -> DataFrame:
    """Number of documents that hold each term; the input has one row per term and document."""
    return occurrences.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def term_stats(occurrences: DataFrame, documents: Column, k: float = DEFAULT_K) -> DataFrame:
    """Document frequency and inverse document frequency of each term."""
    n, total = F.col("df"), documents
    idf = F.log((total - n + F.lit(0.5)) / (n + F.lit(0.5)) + F.lit(k))
    return doc_freq(occurrences).withColumn("idf", idf)


def build_index(
    docs: DataFrame,
    config: BM25Config,
    precision: object = MIN_PRECISION,
    id_col: str = "doc_id",
    check: bool = True,
    spread: bool = True,
) -> Index:
    """The index of a table of documents, as lazy tables.

    With `check`, ids are first tested in a pass of their own over the id column:
    repeated ids or fewer than three documents are errors. To search one index
    many times, write it with `save_index`.

    Documents are first shuffled by id, as text, which is smaller than the counts
    made from it. `spread=False` leaves this out for tables that are bucketed by id
    already; Spark then uses their layout, or shuffles the counts where there is none.
    """
    require_columns(docs, [id_col, *config.field_weights, *config.retained])
    if check:
        require_documents(docs, id_col)
    columns = list(dict.fromkeys([id_col, *config.field_weights, *config.retained]))
    chosen = docs.select(*columns)
    if spread:
        chosen = chosen.repartition(partition_count(docs, TEXT_BYTES), id_col)
    prepared = _token_arrays(chosen, config, id_col)
    documents, tokens = _lengths_of(prepared, config), _tokens_of(prepared, config)
    occurrences = _occurrences_of(prepared, config)
    totals = corpus_totals(documents)
    return Index(
        config,
        precision_of(precision),
        postings=_counts_of(tokens, config),
        documents=documents,
        terms=term_stats(occurrences, totals.select("documents").scalar(), config.k),
        totals=totals,
        tokens=tokens,
        occurrences=occurrences,
    )


def _weight_units(config: BM25Config, precision: int, mean_length: Column) -> Column:
    """Weight of a posting in units of 10^-precision, from columns `freq`, `length` and `idf`."""
    freq, k1, b = F.col("freq"), config.k1, config.b
    norm = F.lit(1.0 - b) + F.lit(b) * (F.col("length") / mean_length)
    below = F.lit(k1) * norm + freq
    error = F.raise_error(F.lit("a weight is infinite: the negative field weights cancel the length norm"))
    saturated = F.abs(freq * F.lit(k1 + 1.0) / below)
    raw = F.when(freq == 0.0, F.lit(0.0)).when(below == 0.0, error.cast("double")).otherwise(saturated)
    return F.signum(freq).cast("long") * half_away_units(raw * F.col("idf"), precision)


def _hot_terms(counts: DataFrame, column: str, parts: str, floor: int) -> DataFrame:
    """Terms with more than a thousandth of all counted rows (`floor` at least), and into how many parts to split them.

    There can be no more than a thousand such terms, so the table can be
    broadcast whatever the corpus.
    """
    total = counts.agg(F.sum(column).alias("n")).scalar()
    limit = F.greatest(total * F.lit(HOT_SHARE), F.lit(float(floor)))
    hot = counts.filter(F.col(column) > limit)
    return F.broadcast(hot.select("term", F.ceil(F.col(column) / limit).cast("int").alias(parts)))


def _join_terms(postings: DataFrame, other: DataFrame, terms: DataFrame, other_id: str | None = None, floor: int | None = None) -> DataFrame:
    """Join postings with another table by term, with frequent terms split over several tasks.

    A term that is frequent in the postings is split by document. If the other
    table holds several rows per term, told apart by `other_id`, a term that is
    frequent there is split by that id as well. Each side is repeated for the parts
    of the other.
    """

    def split(table: DataFrame, key: str, parts: str, part: str) -> DataFrame:
        return table.withColumn(part, F.pmod(F.xxhash64(key), F.coalesce(parts, F.lit(1))).cast("int"))

    def repeat(table: DataFrame, parts: str, part: str) -> DataFrame:
        return table.withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1)))

    floor = HOT_FLOOR if floor is None else floor
    by_document = _hot_terms(terms, "df", "_parts", floor)
    left = split(postings.join(by_document, "term", "left"), "doc_id", "_parts", "_part")
    right = repeat(other.join(by_document, "term", "left"), "_parts", "_part")
    keys = ["term", "_part"]
    if other_id is not None:
        counts = other.groupBy("term").agg(F.count(F.lit(1)).alias("rows"))
        by_other = _hot_terms(counts, "rows", "_slices", floor)
        left = repeat(left.join(by_other, "term", "left"), "_slices", "_slice").drop("_slices")
        right = split(right.join(by_other, "term", "left"), other_id, "_slices", "_slice").drop("_slices")
        keys.append("_slice")
    return left.drop("_parts").join(right.drop("_parts"), keys).drop("_part", "_slice")


def with_units(
    postings: DataFrame, terms: DataFrame, totals: DataFrame, config: BM25Config, precision: int
) -> DataFrame:
    """Postings with their weight, in `units` of 10^-precision. Where the terms may be broadcast, postings stay where they are."""
    units = _weight_units(config, precision, totals.select("mean_length").scalar())
    known = terms.select("term", "idf")
    joined = postings.join(F.broadcast(known), "term") if is_small(known) else _join_terms(postings, known, terms)
    return joined.withColumn("units", units).drop("idf")


def term_slices(postings: DataFrame, terms: DataFrame, buckets: int) -> int:
    """In how many steps stored postings are laid out by term, a step taking the buckets of one remainder.

    What a step shuffles goes before the next one, and the terms of a step may be broadcast.
    """
    rows, size = measure(terms.select("term", "idf"))
    wanted = max(min(math.ceil(scan_bytes(postings) / SLICE_BYTES), SLICES), 1)
    # A quarter more, as hashes do not deal evenly.
    return min(max(wanted, math.ceil(1.25 * max(rows / BROADCAST_ROWS, size / BROADCAST_BYTES))), buckets)


def step_partitions(spark: SparkSession, partitions: int, slices: int) -> int:
    """Partitions of a step, of as many as the whole has: a share of them, or as many as run at a time."""
    return min(partitions, max(math.ceil(partitions / slices), spark.sparkContext.defaultParallelism))


def counted(index: Index) -> Index:
    """`index` with its counts written to the work folder, so that texts are cut into tokens once.

    Statistics come from the written counts. An index that is read from files is left as it is.
    """
    if index.tokens is None:
        return index
    return with_counts(index, materialise(index.postings, "counts"), materialise(index.documents, "lengths"))


def with_counts(index: Index, postings: DataFrame, documents: DataFrame) -> Index:
    """`index` over its counts and lengths as they were written."""
    totals = corpus_totals(documents)
    terms = term_stats(postings.select("term"), totals.select("documents").scalar(), index.config.k)
    return Index(index.config, index.precision, postings, documents, terms, totals, occurrences=postings.select("term"))


def weighted_postings(index: Index, hot_floor: int | None = None, chosen: Column | None = None) -> DataFrame:
    """Every posting with its weight in `units`, and the `idf` of its term; stored weights are read, not computed.

    With `chosen`, a condition on the term, only postings of such terms; these stay where they are if the terms may be broadcast.
    """
    index = counted(index)
    postings, terms = (t if chosen is None else t.filter(chosen) for t in (index.postings, index.terms))
    known = terms.select("term", "idf")
    if chosen is not None and is_small(known):
        joined = postings.join(F.broadcast(known), "term")
    else:
        joined = _join_terms(postings, known, terms, floor=hot_floor)
    if index.stored_weights:
        return joined
    return joined.withColumn("units", _weight_units(index.config, index.precision, index.total("mean_length")))


def weights(index: Index, hot_floor: int | None = None) -> DataFrame:
    """The consolidated weight of every posting: `(doc_id, term, units, weight)`, exact in `units` of 10^-precision.

    Terms of at least `hot_floor` postings that hold more than a thousandth of all are split when joined.
    """
    return (
        weighted_postings(index, hot_floor)
        .select("doc_id", "term", "units")
        .withColumn("weight", F.col("units") / F.lit(10.0**index.precision))
    )


def query_terms(queries: DataFrame, config: BM25Config, text: str = "text") -> DataFrame:
    """Terms of each query and how often each occurs: `(query_id, term, times)`."""
    return (
        queries.select("query_id", F.explode(config.tokens(F.col(text), "search")).alias("term"))
        .filter(F.col("term").isNotNull())
        .groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).alias("times"))
    )


def match_scores(
    index: Index,
    queries: DataFrame,
    where: Column | None = None,
    text: str = "text",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Score of every document that shares a term with a query: `(query_id, doc_id, units)`.

    A term repeated in a query counts each time. `where` is a condition on the
    retained fields. Query terms are broadcast if their measured size allows it,
    so that matching needs no shuffle; otherwise both sides are joined by term,
    with frequent terms split.
    """
    terms = query_terms(queries, index.config, text)
    # With the size of the query side come the buckets it needs: never more numbers than there are buckets.
    wanted = [] if index.buckets is None else [F.collect_set(bucket_of(F.col("term"), index.buckets))]
    rows, size, *buckets = measure(terms, *wanted)
    if fits(rows, size, broadcast_rows):
        used = terms.select("term").distinct()
        if index.stored_weights:
            # The extra row tells whether there are more terms than may be listed.
            first = [r["term"] for r in used.limit(LISTED_TERMS + 1).collect()]
            listed = first if len(first) <= LISTED_TERMS else None
            matched = index.known_postings(used, *buckets, listed=listed)
            # Stored postings lie by term. They are moved once each, before a posting has a row for every query that asks for it.
            matched = matched.repartition(partition_count(matched), "doc_id").join(F.broadcast(terms), "term")
        else:
            known = terms.join(index.known_terms(used, *buckets).select("term", "idf"), "term")
            matched = index.known_postings(used, *buckets).join(F.broadcast(known), "term")
    else:
        index = counted(index)
        known = terms.join(index.terms.select("term", "idf"), "term")
        matched = _join_terms(index.postings, known, index.terms, "query_id")
    units = F.col("units")
    if not index.stored_weights:
        units = _weight_units(index.config, index.precision, index.total("mean_length"))
    hits = matched.groupBy("query_id", "doc_id").agg(F.sum(units * F.col("times")).alias("units"))
    if where is not None:
        hits = hits.join(index.documents.filter(where).select("doc_id"), "doc_id", "left_semi")
    return hits.select("query_id", "doc_id", "units")


def result_limit(limit: int | None) -> int | None:
    """0 means the default of 10, less means 1, and None means all matches."""
    if limit is None:
        return None
    return max(limit or DEFAULT_LIMIT, 1)


def search(
    index: Index,
    queries: DataFrame,
    limit: int | None = DEFAULT_LIMIT,
    where: Column | None = None,
    text: str = "text",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """The best documents of each query: `(query_id, doc_id, score, rank)`; equal scores by document id."""
    hits = match_scores(index, queries, where, text, broadcast_rows)
    ranked = top_per_group(hits, ["query_id"], [F.col("units").desc(), F.col("doc_id").asc()], result_limit(limit))
    score = (F.col("units") / F.lit(10.0**index.precision)).alias("score")
    return ranked.select("query_id", "doc_id", score, "rank")


def inverted_index(index: Index, block: int = 1024) -> DataFrame:
    """Documents of each term in ascending order, in blocks: `(term, block, doc_ids)`.

    Blocks bound the arrays, however many documents hold a term.
    """
    ranked = rank_all(index.postings.select("term", "doc_id"), ["term"], [F.col("doc_id").asc()], "place")
    return (
        ranked.withColumn("block", F.floor((F.col("place") - 1) / block))
        .groupBy("term", "block")
        .agg(F.sort_array(F.collect_list("doc_id")).alias("doc_ids"))
    )


def vocabulary(docs: DataFrame, config: BM25Config, id_col: str = "doc_id") -> DataFrame:
    """Terms numbered from 0 in the order they are first seen, by document, field and position."""
    # The order of first sight inside a document is that of its distinct terms.
    seen = _token_arrays(docs, config, id_col).select("doc_id", F.posexplode(_distinct_terms(config)).alias("pos", "term"))
    first = seen.filter(F.col("term").isNotNull()).groupBy("term").agg(F.min(F.struct("doc_id", "pos")).alias("at"))
    ranked = rank_all(first, [], [F.col("at").asc()], "term_id")
    return ranked.select("term", (F.col("term_id") - 1).alias("term_id"))


# The same operations under the names of a learner.
learn = build_index
predict = search

"""All words of a query marked in the texts of its hits, as they are written there."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.functions.prep import Step
from lexivec.functions.text import normalize_text

# A word with the marks that stand on its letters, or what lies between two words: together the whole text.
WRITTEN = r"\p{L}[\p{L}\p{M}]*"
PIECE = rf"{WRITTEN}|[^\p{{L}}]+"


def _forms(words: Column, steps: Sequence[Step]) -> Column:
    """The searched form of each written word: normalised, then by steps that keep the number of words."""
    # Words hold no line break, so a whole text is normalised at once.
    formed = F.split(normalize_text(F.array_join(words, "\n")), "\n")
    for step in steps:
        formed = step(formed)
    return formed


def highlight_terms(
    hits: DataFrame,
    text: str = "text",
    query: str = "query",
    steps: Sequence[Step] = (),
    ignored: Iterable[str] = (),
    before: str = "<strong>",
    after: str = "</strong>",
) -> DataFrame:
    """Add `marked`, the text with every word of the query enclosed, and `spans`, where these words stand.

    A word of the text is marked if its form is that of a word of the query: in lower
    case, without accents and, with `steps=(stem_tokens,)`, stemmed; the text keeps
    its own spelling. Forms in `ignored`, such as stop words, are never marked. The
    words of the query are one set that each word of the text is looked up in, in one
    pass over the text. `spans` is a list of `(start, end, form)` by place, in
    characters, the end exclusive. A null text gives nulls; a null or empty query marks nothing.
    `hits` must have no columns of these names, nor any that begin with `_h_`.
    """
    taken = {"marked", "spans"} & set(hits.columns)
    if taken:
        raise ValueError(f"there are columns of these names already: {sorted(taken)}")
    asked = F.regexp_extract_all(F.coalesce(F.col(query), F.lit("")), F.lit(WRITTEN), F.lit(0))
    left_out = sorted(set(ignored))
    pieces = hits.withColumn("_h_pieces", F.regexp_extract_all(F.col(text), F.lit(PIECE), F.lit(0))).withColumn("_h_asked", asked)
    # Words and what lies between them take turns, so the first piece tells which are words.
    second = F.when(F.get("_h_pieces", F.lit(0)).rlike(r"^\p{L}"), 0).otherwise(1)
    words = F.filter("_h_pieces", lambda _, i: i % 2 == F.col("_h_second"))
    formed = (
        pieces.withColumn("_h_second", second)
        .withColumn("_h_forms", _forms(words, steps))
        .withColumn("_h_terms", F.array_distinct(_forms(F.col("_h_asked"), steps)))
    )
    # Splitting an empty text gives one empty form, which is no word.
    wanted = F.filter("_h_terms", lambda t: (t != "") & ~t.isin(left_out))
    found = formed.withColumn("_h_terms", wanted)

    def form_at(i: Column) -> Column:
        return F.get("_h_forms", F.floor((i - F.col("_h_second")) / 2).cast("int"))

    def is_hit(i: Column) -> Column:
        return (i % 2 == F.col("_h_second")) & F.array_contains("_h_terms", form_at(i))

    marked = F.transform("_h_pieces", lambda p, i: F.when(is_hit(i), F.concat(F.lit(before), p, F.lit(after))).otherwise(p))
    places = F.filter(F.sequence(F.lit(0), F.size("_h_pieces") - 1), is_hit)
    found = found.withColumn("_h_places", F.when(F.size("_h_pieces") > 0, places).otherwise(F.array().cast("array<int>")))

    def add(done: Column, i: Column) -> Column:
        """The next span: its start is the end of the last one and the length of what lies between."""
        between = F.array_join(F.slice("_h_pieces", done["next"] + 1, i - done["next"]), "")
        start = done["at"] + F.length(between)
        end = start + F.length(F.get("_h_pieces", i))
        span = F.struct(start.alias("start"), end.alias("end"), form_at(i).alias("form"))
        return F.struct(F.concat(done["spans"], F.array(span)).alias("spans"), end.alias("at"), (i + 1).alias("next"))

    none = F.struct(
        F.array().cast("array<struct<start:int,end:int,form:string>>").alias("spans"), F.lit(0).alias("at"), F.lit(0).alias("next")
    )
    spans = F.aggregate("_h_places", none, add, lambda done: done["spans"])
    given = F.col(text).isNotNull()
    return found.select(
        *(F.col(f"`{c}`") for c in hits.columns),
        F.when(given, F.array_join(marked, "")).alias("marked"),
        F.when(given, spans).alias("spans"),
    )

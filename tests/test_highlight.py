import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lexivec.functions.stemming import stem, stem_tokens
from lexivec.operators.highlight import highlight_terms

SCHEMA = "id long, text string, query string"


def normal(word):
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not "̀" <= c <= "ͯ")


def plain(text, query, form=normal):
    """Spans and marked text, found word by word."""
    if text is None:
        return None, None
    word = re.compile("[^\\W\\d_][^\\W\\d_̀-ͯ]*(?:[̀-ͯ]+[^\\W\\d_]*)*")
    asked = {form(w) for w in word.findall(query or "")}
    spans = [(m.start(), m.end(), form(m[0])) for m in word.finditer(text) if form(m[0]) in asked]
    for start, end, _ in reversed(spans):
        text = f"{text[:start]}<strong>{text[start:end]}</strong>{text[end:]}"
    return text, spans


def found(df):
    return {r.id: (r.marked, r.spans and [tuple(s) for s in r.spans] if r.spans is not None else None) for r in df.collect()}


LETTERS = "aAbéÉñÑ 1.\n-😀日"


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text(LETTERS, max_size=25), st.text(LETTERS, max_size=6)), min_size=40, max_size=60))
def test_offsets_and_marks(spark, pairs):
    rows = [(i, t, q) for i, (t, q) in enumerate(pairs)]
    got = found(highlight_terms(spark.createDataFrame(rows, SCHEMA)))
    assert got == {i: plain(t, q) for i, t, q in rows}


def test_cases(spark):
    rows = [
        (1, "Café, CAFÉ and cafes: a café-bar", "the cafe"),
        (2, None, "a"),
        (3, "text", None),
        (4, "", "a"),
        (5, "12 . 3", "x"),
        (6, "word", "!!"),
        (7, "one two one", "ONE zwei"),
        (8, "$1 \\ one$", "one"),
    ]
    got = found(highlight_terms(spark.createDataFrame(rows, SCHEMA)))
    assert got == {i: plain(t, q) for i, t, q in rows}
    assert got[1][1] == [(0, 4, "cafe"), (6, 11, "cafe"), (25, 29, "cafe")]
    assert got[4] == ("", []) and got[2] == (None, None)


def test_stems_and_ignored_words(spark):
    rows = [(1, "The runner was Running; runs the town", "the run")]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = found(highlight_terms(frame, steps=(stem_tokens,), ignored=["the"], before="[", after="]"))
    assert got[1][0] == "The runner was [Running]; [runs] the town"
    assert got[1][1] == [(15, 22, stem("running")), (24, 28, stem("runs"))]


def test_long_texts_and_clashing_names(spark):
    long = "some word, " * 30_000
    got = found(highlight_terms(spark.createDataFrame([(1, long + "end", "End")], SCHEMA)))
    assert got[1][1] == [(len(long), len(long) + 3, "end")]
    with pytest.raises(ValueError, match="already"):
        highlight_terms(spark.createDataFrame([(1, "a", "b")], "id long, text string, marked string"), query="marked")

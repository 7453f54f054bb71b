import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexivec.functions import collections as lists
from lexivec.functions import text
from lexivec.functions.prep import STEMMED_WORDS, apply_steps
from lexivec.functions.stemming import stem, stem_tokens


def apply(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string").coalesce(1)
    return [r["v"] for r in df.select("i", f(F.col("c")).alias("v")).orderBy("i").collect()]


def test_tokenize(spark):
    got = apply(spark, text.tokenize, "Don't PANIC, Señor 42!", "", None)
    assert got == [["don", "t", "panic", "señor"], [], None]


def test_stop_words_keep_order_and_repeats(spark):
    tokens = lambda c: text.remove_stop_words(text.tokenize(c))
    assert apply(spark, tokens, "the cat and the cat sat") == [["cat", "cat", "sat"]]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("not good at all. fine", ["not", "!good", "!at", "!all", "fine"]),
        ("It isn't very good, but cheap", ["it", "isn", "t", "!very", "!good", "but", "cheap"]),
        ("I have no money; never mind", ["i", "have", "no", "!money", "never", "!mind"]),
        ("nothing known", ["nothing", "known"]),
        ("not now not ever", ["not", "!now", "!not", "!ever"]),
        ("a\x01b not\x02 c", ["ab", "not", "!c"]),
        ("no", ["no"]),
        ("", []),
    ],
)
def test_negation(spark, given, wanted):
    assert apply(spark, text.mark_negation, given) == [wanted]


def test_full_preparation(spark):
    prepared = lambda c: apply_steps(c, STEMMED_WORDS)
    assert apply(spark, prepared, "The kids were not eating healthy meals. Poverty rates", None) == [
        ["kid", "!eat", "!healthi", "!meal", "poverti", "rate"],
        None,
    ]


STEMS = {
    "consistency": "consist", "consolingly": "consol", "conspiracies": "conspiraci", "knightly": "knight",
    "knitted": "knit", "generously": "generous", "communities": "communiti", "cries": "cri", "ties": "tie",
    "gas": "gas", "kiwis": "kiwi", "hoping": "hope", "hopping": "hop", "happy": "happi", "say": "say",
    "relational": "relat", "electricity": "electr", "formative": "format", "adoption": "adopt",
    "controlling": "control", "malnutrition": "malnutrit", "agreed": "agre", "luxuriated": "luxuri",
    "news": "news", "shed": "shed", "analogies": "analog", "skis": "ski", "proceed": "proceed",
    "youth": "youth", "by": "by", "sayyed": "sayi", "dying": "die", "!spending": "!spend", "niños": "niño",
}


def test_stems(spark):
    assert {w: stem(w) for w in STEMS} == STEMS
    got = apply(spark, lambda c: stem_tokens(F.split(c, " ")), " ".join(STEMS), None)
    assert got == [list(STEMS.values()), None]


def plain(value):
    return "".join(c for c in unicodedata.normalize("NFD", value.lower()) if not "̀" <= c <= "ͯ")


def test_normalize_known(spark):
    given = ["Nestlé", "ÀÉÎÕÜ ñ ç ß", "é", "한국어 각", "ガギグ パ", "क़ख़", "ﬁ", "Å Ω", "plain", "", None]
    wanted = [None if v is None else plain(v) for v in given]
    assert wanted[0] == "nestle"
    assert apply(spark, text.normalize_text, *given) == wanted


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(st.characters(min_codepoint=32, max_codepoint=0xFFFF, exclude_categories=["Cs", "Cn", "Mn", "Lu", "Lt"]))))
def test_normalize_equals_unicode_data(spark, values):
    # Free combining marks are left out: their canonical order in a text is not rearranged.
    assert apply(spark, text.normalize_text, *values, "x") == [plain(v) for v in [*values, "x"]]


def test_contains_and_highlight(spark):
    assert apply(spark, lambda c: text.keyword_contains(c, "PoVerty"), "On poverty", "rich") == [True, False]
    got = apply(spark, lambda c: text.highlight(c, "a.b"), "A.b and axb a.B", "axb", "$1 a.b")
    assert got == ["<strong>A.b</strong> and axb <strong>a.B</strong>", "axb", "$1 <strong>a.b</strong>"]
    by_column = apply(spark, lambda c: text.highlight(c, F.lit("(Ñ)")), "x (ñ) y")
    assert by_column == ["x <strong>(ñ)</strong> y"]


def test_list_product(spark):
    got = apply(spark, lambda c: lists.list_product([F.array(F.lit(9), F.lit(8)), F.array(F.lit(1), F.lit(2))]), "x")
    assert got == [[[9, 1], [9, 2], [8, 1], [8, 2]]]
    three = apply(spark, lambda c: lists.list_product([F.split(F.lit(s), "") for s in ("ab", "c", "de")]), "x")
    assert three == [[list(p) for p in ("acd", "ace", "bcd", "bce")]]
    assert apply(spark, lambda c: lists.list_product([]), "x") == [[[]]]


def test_sort_elements_is_stable(spark):
    words = lambda c: F.split(c, " ")
    assert apply(spark, lambda c: lists.sort_elements(words(c)), "b a c a") == [["a", "a", "b", "c"]]
    assert apply(spark, lambda c: lists.sort_elements(words(c), F.length, True), "bb a cc d eee") == [
        ["eee", "bb", "cc", "a", "d"]
    ]


def test_pluck(spark):
    rows = lambda c: F.transform(F.split(c, ";"), lambda r: F.split(r, ","))
    assert apply(spark, lambda c: lists.pluck(rows(c)), "a,b;c,d;e") == [["a", "c", "e"]]
    assert apply(spark, lambda c: lists.pluck(rows(c), 1), "a,b;c,d;e") == [["b", "d", None]]
    assert apply(spark, lambda c: lists.pluck(rows(c), 0, 2), "a,b;c,d;e") == [["a", "c"]]
    assert apply(spark, lambda c: lists.pluck(rows(c), 0, 9), "a,b;c,d") == [["a", "c"]]


def test_last_value(spark):
    pairs = F.from_json("c", "array<struct<id: string, value: string>>")
    given = '[{"id":"a","value":"1"},{"id":"b","value":"2"},{"id":"a","value":"3"}]'
    assert apply(spark, lambda c: lists.last_value(pairs, F.lit("a")), given, "[]") == ["3", None]


def test_stems_of_nulls_and_empty_lists(spark):
    rows = [(1, ["running", "!cats", "running"]), (2, None), (3, []), (4, ["ponies", None])]
    found = spark.createDataFrame(rows, "id long, t array<string>").coalesce(1).select("id", stem_tokens(F.col("t")).alias("s"))
    assert sorted(map(tuple, found.collect())) == [(1, ["run", "!cat", "run"]), (2, None), (3, []), (4, ["poni", None])]

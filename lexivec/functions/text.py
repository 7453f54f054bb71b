"""Text functions as column expressions."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stop words of Spark MLlib's StopWordsRemover.
STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
    she her hers herself it its itself they them their theirs themselves what which who whom
    this that these those am is are was were be been being have has had having do does did
    doing a an the and but if or because as until while of at by for with about against between
    into through during before after above below to from up down in out on off over under again
    further then once here there when where why how all any both each few more most other some
    such no nor not only own same so than too very s t can will just don should now
    i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's
    she's it's we're they're i've we've you've they've isn't aren't wasn't weren't haven't
    hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't
    cannot could here's how's let's ought that's there's what's when's where's who's why's would
    """.split()
)

WORD = r"\p{L}+"
WHOLE_WORD = r"\p{L}+(?:['’]\p{L}+)*"
CONTRACTIONS = sorted(w for w in STOP_WORDS if "'" in w)

# A negation reaches from its word to the next of these marks.
SCOPE_END = r".,;:!?()\[\]{}\"…—"
NEGATOR = r"(?:no|not|never|\p{L}+n['’]t)"
NEGATED_SPAN = rf"((?:^|[^\p{{L}}]){NEGATOR})([^\p{{L}}{SCOPE_END}][^{SCOPE_END}]*)"


def tokenize(text: Column) -> Column:
    """Lower-cased runs of letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def content_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, without those of contractions that are stop words."""
    whole = F.regexp_extract_all(F.lower(text), F.lit(WHOLE_WORD), F.lit(0))
    kept = F.filter(whole, lambda w: ~F.replace(w, F.lit("’"), F.lit("'")).isin(CONTRACTIONS))
    return F.flatten(F.transform(kept, tokenize))


def remove_stop_words(tokens: Column, words: Iterable[str] = STOP_WORDS) -> Column:
    """Drop stop words, keep order and repeats; a negated token is judged by its bare word."""
    listed = sorted(set(words))
    return F.filter(tokens, lambda t: ~F.ltrim(t, F.lit("!")).isin(listed))


def mark_negation(text: Column, tokens: Callable[[Column], Column] = tokenize) -> Column:
    """Tokens of the text, with `!` before those inside the reach of a negation."""
    # Control characters 1 and 2 enclose a reach; any of the text's own are dropped first.
    clean = F.translate(F.lower(text), "\x01\x02", "")
    spans = F.split(F.regexp_replace(clean, NEGATED_SPAN, "$1\x01$2\x02"), "[\x01\x02]")
    marked = F.transform(
        spans,
        lambda s, i: F.when(
            i % 2 == 1,
            F.transform(tokens(s), lambda t: F.concat(F.lit("!"), t)),
        ).otherwise(tokens(s)),
    )
    return F.flatten(marked)


def _is_stripped(ch: str) -> bool:
    return "\u0300" <= ch <= "\u036f"


@lru_cache(maxsize=1)
def _decompositions() -> tuple[str, str, dict[str, str]]:
    """Canonical decompositions, computed from the Unicode data.

    Returns the characters that become at most one character and what they become,
    in the form `translate` takes, and those that become several, by what follows
    their first character. Hangul is left out: it has a rule of its own.
    """
    single: dict[str, str] = {}
    several: dict[str, list[tuple[str, str]]] = {}
    for code in range(sys.maxunicode + 1):
        ch = chr(code)
        if "가" <= ch <= "힣" or 0xD800 <= code <= 0xDFFF or ch.lower() != ch:
            continue
        plain = "".join(c for c in unicodedata.normalize("NFD", ch) if not _is_stripped(c))
        if plain == ch:
            continue
        if len(plain) <= 1:
            single[ch] = plain
        else:
            single[ch] = plain[0]
            several.setdefault(plain[1:], []).append(ch)
    kept = [c for c, p in single.items() if p]
    dropped = [c for c, p in single.items() if not p]
    rest = {tail: "".join(chars) for tail, chars in several.items()}
    return "".join(kept + dropped), "".join(single[c] for c in kept), rest


def _char_class(chars: str) -> str:
    """A regular-expression class, with runs of characters as ranges."""
    codes = sorted({ord(c) for c in chars})
    starts = [c for c in codes if c - 1 not in codes]
    ends = [c for c in codes if c + 1 not in codes]
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in zip(starts, ends, strict=True)) + "]"


def _append(text: Column, tails: dict[str, str]) -> Column:
    """Put each tail after every one of its characters."""
    classes, puts = "\n".join(_char_class(c) for c in tails.values()), "\n".join("$0" + t for t in tails)
    # One constant each, which Spark splits once; hundreds of literals would be slow to build.
    rules = F.arrays_zip(F.split(F.lit(classes), "\n").alias("chars"), F.split(F.lit(puts), "\n").alias("put"))
    return F.aggregate(rules, text, lambda done, rule: F.regexp_replace(done, rule["chars"], rule["put"]))


def _split_hangul(text: Column) -> Column:
    """Hangul syllables as their letters, by the arithmetic of the Unicode standard."""
    first, vowel, last, syllable = 0x1100, 0x1161, 0x11A7, 0xAC00
    pairs = range(19 * 21)
    open_syllables = [chr(syllable + pair * 28) for pair in pairs]
    closed = {chr(last + t): "".join(chr(syllable + pair * 28 + t) for pair in pairs) for t in range(1, 28)}
    by_vowel = {chr(vowel + v): "".join(open_syllables[v::21]) for v in range(21)}
    text = F.translate(_append(text, closed), "".join(closed.values()), "".join(open_syllables) * 27)
    leads = "".join(chr(first + pair // 21) for pair in pairs)
    return F.translate(_append(text, by_vowel), "".join(open_syllables), leads)


def normalize_text(text: Column) -> Column:
    """Lower case, decompose, strip the marks U+0300 to U+036F.

    ASCII texts need no more than lower case, and most others one `translate`.
    Characters that become several are handled by replacements which run only on
    the texts that hold such characters.
    """
    source, target, several = _decompositions()
    low = F.lower(text)
    rare = "".join(several.values())
    # The plain range test is cheap and settles texts in European scripts.
    is_rare = low.rlike(rf"[\x{{{ord(min(rare)):X}}}-\x{{10FFFF}}]") & low.rlike(_char_class(rare)[:-1] + "가-힣]")
    spread = F.when(is_rare, _append(low, several)).otherwise(low)
    spread = F.when(low.rlike("[가-힣]"), _split_hangul(spread)).otherwise(spread)
    return F.when(low.rlike(r"[^\x00-\x7F]"), F.translate(spread, source, target)).otherwise(low)


def keyword_contains(text: Column, query: Column | str) -> Column:
    """Case-insensitive literal substring test."""
    return F.contains(F.lower(text), F.lower(F.lit(query)))


def highlight(text: Column, query: Column | str) -> Column:
    """Wrap each case-insensitive occurrence of the query in `<strong>`."""
    if isinstance(query, Column):
        quoted = F.regexp_replace(query, r"([^\p{L}\p{N}\s])", r"\\$1")
    else:
        quoted = F.lit(re.sub(r"([^\w\s])", r"\\\1", query))
    marked = F.regexp_replace(text, F.concat(F.lit("(?iu)"), quoted), F.lit("<strong>$0</strong>"))
    return F.when(keyword_contains(text, query), marked).otherwise(text)

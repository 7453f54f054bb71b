"""English stemming by the published Porter2 rules, applied to token arrays in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOWEL = "[aeiouy]"

# Words that a task remembers at once.
REMEMBERED = 200_000

# The exceptional words of the published rules and their stems.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURAL = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}

# Suffix tables of steps 2, 3 and 4.
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent",
    "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous",
    "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "fulli": "ful", "lessli": "less",
}
STEP_3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic",
    "ical": "ic", "ful": "", "ness": "",
}
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ism", "ate", "iti", "ous", "ive", "ize",
)


def _longest(word: str, suffixes) -> str | None:
    found = [s for s in suffixes if word.endswith(s)]
    return max(found, key=len) if found else None


def _region(word: str, start: int) -> int:
    """Where the region after the first vowel-consonant pair begins."""
    match = re.compile(f"{VOWEL}[^aeiouy]").search(word, start)
    return match.end() if match else len(word)


def _ends_short(word: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", word) or re.fullmatch(r"[aeiouy][^aeiouy]", word))


def _plural(word: str) -> str:
    suffix = _longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if suffix == "sses":
        return word[:-2]
    if suffix in ("ied", "ies"):
        return word[:-2] if len(word) > 4 else word[:-1]
    if suffix == "s" and re.search(VOWEL, word[:-2]):
        return word[:-1]
    return word


def _past(word: str, r1: int) -> str:
    suffix = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if suffix is None:
        return word
    base = word[: -len(suffix)]
    if suffix in ("eed", "eedly"):
        return base + "ee" if len(base) >= r1 else word
    if not re.search(VOWEL, base):
        return word
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if base.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
        return base[:-1]
    if r1 >= len(base) and _ends_short(base):
        return base + "e"
    return base


def _derived(word: str, r1: int, r2: int) -> str:
    suffix = _longest(word, (*STEP_2, "ogi", "li"))
    if suffix and len(word) - len(suffix) >= r1:
        base = word[: -len(suffix)]
        if suffix == "ogi":
            word = word[:-1] if base.endswith("l") else word
        elif suffix == "li":
            word = base if re.search("[cdeghkmnrt]$", base) else word
        else:
            word = base + STEP_2[suffix]
    suffix = _longest(word, (*STEP_3, "ative"))
    if suffix and len(word) - len(suffix) >= r1:
        base = word[: -len(suffix)]
        if suffix != "ative":
            word = base + STEP_3[suffix]
        elif len(base) >= r2:
            word = base
    suffix = _longest(word, (*STEP_4, "ion"))
    if suffix and len(word) - len(suffix) >= r2:
        base = word[: -len(suffix)]
        if suffix != "ion" or base.endswith(("s", "t")):
            word = base
    return word


def _final_letter(word: str, r1: int, r2: int) -> str:
    base = word[:-1]
    if word.endswith("e") and (len(base) >= r2 or (len(base) >= r1 and not _ends_short(base))):
        return base
    if word.endswith("ll") and len(base) >= r2:
        return base
    return word


def stem(word: str) -> str:
    """The stem of one lower-case word; a leading `!` stays in front."""
    if word.startswith("!"):
        return "!" + stem(word[1:])
    if len(word) <= 2:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    # A y that acts as a consonant is written Y until the end.
    word = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", word))
    prefix = re.match("gener|commun|arsen", word)
    r1 = prefix.end() if prefix else _region(word, 0)
    r2 = _region(word, r1)
    word = _plural(word)
    if word in KEPT_AFTER_PLURAL:
        return word
    word = _past(word, r1)
    word = re.sub(r"(?<=.[^aeiouy])[yY]$", "i", word)
    word = _final_letter(_derived(word, r1, r2), r1, r2)
    return word.lower()


def stem_tokens(tokens: Column) -> Column:
    """Stem each token of an array.

    The arrays go through Python batch by batch and need no shuffle. The different
    words of a batch are worked out, and a task remembers those it has seen.
    """

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def stems(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, str] = {}

        def look_up(word: str) -> str:
            found = known.get(word)
            if found is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                found = known[word] = stem(word)
            return found

        for batch in batches:
            words = batch.flatten().dictionary_encode()
            found = pa.array([None if w is None else look_up(w) for w in words.dictionary.to_pylist()], pa.string()).take(words.indices)
            ends = np.cumsum(batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), found, mask=batch.is_null())

    return stems(tokens)

"""Ready-made chains of text preparation: each turns a text column into a token array."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column

from lexivec.functions.stemming import stem_tokens
from lexivec.functions.text import content_tokens, mark_negation, remove_stop_words, tokenize

Step = Callable[[Column], Column]

WORDS: tuple[Step, ...] = (tokenize,)
CONTENT_WORDS: tuple[Step, ...] = (content_tokens, remove_stop_words)
STEMMED_WORDS: tuple[Step, ...] = (lambda text: mark_negation(text, content_tokens), remove_stop_words, stem_tokens)


def apply_steps(text: Column, steps: Sequence[Step]) -> Column:
    for step in steps:
        text = step(text)
    return text

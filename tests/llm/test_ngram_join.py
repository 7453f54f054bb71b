"""The shingle join against all pairs, its keys against any classes of tokens, its bitmaps against set differences."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plain import LOWER, WORD

from lexivec.llm import ngram_join

SCHEMA = "doc_id long, text string, row string, n int, a string, b int, bits string, key long"


def frame(spark, docs):
    """Documents with extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(d, t, "x", 1, "y", 2, "z", 3) for d, t in docs], SCHEMA).repartition(3)


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 4]) for i in range(max(len(words) - 3, 1))} if words else set()


def plain(docs, percent=85):
    """{(doc_id, size, smallest id reachable)} of rows with ids."""
    rows = list(dict.fromkeys(docs))
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    rank = {i: n for n, i in enumerate(order)}
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)), key=rank.get)
                root[y] = x
    return sorted(((d, len(s), rows[find(i)][0] if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def corpus():
    random.seed(4)
    vocabulary = [f"w{i}" for i in range(500)]
    draw = lambda k: [random.choice(vocabulary) for _ in range(k)]
    passage, docs = draw(40), []
    for _ in range(25):
        docs.append(" ".join(draw(random.randint(1, 60)) + passage * random.randint(0, 1) + draw(random.randint(1, 8))))
    for size in (30, 120, 400):  # groups of near copies, with more and more changes
        base = draw(size)
        for i in range(30):
            copy = list(base)
            for _ in range(i * size // 400):
                copy[random.randrange(size)] = random.choice(vocabulary)
            docs.append(" ".join(copy))
    docs += [docs[0].upper(), docs[1].replace(" ", "\t"), "x " * 3000, "y z " * 9000]
    docs += [None, "", " \n\t ", "one", "one two three", "ONE twoé three", "a b c d", "a b c d e"]
    return list(enumerate(docs)) + [(3, docs[3]), (None, docs[30]), (None, docs[30]), (None, None), (5, docs[40])]


@pytest.mark.parametrize("bits", [18, 6])
def test_components(spark, monkeypatch, bits):
    """Also with so few cells that all tokens share a class with many others."""
    monkeypatch.setattr(ngram_join, "CELL_BITS", bits)
    docs = corpus()
    got = ngram_join.ngram_components(frame(spark, docs)).collect()
    assert len(got) == len(docs)
    assert sorted({tuple(r) for r in got}, key=str) == sorted(set(plain(docs)), key=str)


def test_empty_tables_and_limits(spark):
    assert ngram_join.ngram_components(frame(spark, [])).collect() == []
    got = ngram_join.ngram_components(frame(spark, [(1, None), (2, " "), (None, "a")])).collect()
    assert sorted((tuple(r) for r in got), key=str) == [(1, 0, 1), (2, 0, 2), (None, 1, None)]
    with pytest.raises(ValueError):
        ngram_join.ngram_components(frame(spark, []), percent=60)


@settings(max_examples=600, deadline=None)
@given(st.integers(67, 99), st.integers(1, 60), st.integers(0, 2**32), st.sampled_from([0.0, 0.1, 0.5, 0.9, 1.0]))
def test_linked_sets_share_a_key(percent, size, seed, share):
    """Whatever tokens are called frequent."""
    random.seed(seed)
    base = random.sample(range(2**62), size + 30)
    left, right = set(base[:size]), set(base[:size])
    for extra in base[size : size + random.randint(0, 2 + size // 4)]:
        random.choice((left, right)).add(extra)
        if random.random() < 0.5:
            (left if random.random() < 0.5 else right).discard(random.choice(base[:size]))
    if not left or not right or 100 * len(left & right) < percent * len(left | right) or left == right:
        return
    classes = np.array([0 if random.random() > share else random.randint(1, 3) for _ in range(64)], np.uint8)
    x, y = (set(ngram_join.keys(np.array(sorted(s), np.uint64), classes, percent).tolist()) for s in (left, right))
    assert x & y


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 300), st.integers(0, 80), st.integers(0, 2**32))
def test_bitmaps_never_differ_more_than_sets(size, more, seed):
    random.seed(seed)
    tokens = np.array(random.sample(range(2**62), size + more), np.uint64)
    a, b = (ngram_join.bitmap(t) for t in (tokens[:size], tokens[more // 2 :]))
    while len(a) != len(b):
        longer = a if len(a) > len(b) else b
        half = longer[: len(longer) // 2] ^ longer[len(longer) // 2 :]
        a, b = (half, b) if longer is a else (a, half)
    assert sum(int(x).bit_count() for x in (a ^ b).view(np.uint64)) <= more // 2 + more

"""Packing against the tokenizer itself, an exact reading of the layout, and bounds on the number of sequences."""

import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexivec.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, task string, length double"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def texts():
    random.seed(7)
    words = ["the", "of", "naïve", "x1", "don't", "we'll", "a", "Ωmega", "123", "!?", "日本", "\U0001f600"]
    blanks = [" ", " ", " ", "  ", "\n", " \n", "\n ", "   ", "\t", " ", "  ", "\x1c", "\r\n"]
    made = ["".join(random.choice(words) + random.choice(blanks) for _ in range(random.randint(0, 40))) for _ in range(300)]
    return [*made, None, "", " ", "\n", " a", "a ", "a<|endoftext|>b c", "word " * 5000, "x" * 30000, "a b", "a b", "a\n \nb"]


def test_ids_equal_the_tokenizer(tokenizer):
    encode = packing.Encoder(PATH)
    for text in texts():
        assert encode(text or "") == np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def check(rows, docs, tokenizer, size):
    wanted = []
    for doc, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        for number, (start, length) in enumerate(packing.cut(len(ids), size)):
            wanted.append((doc, number, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(wanted, key=key)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences), math.ceil(sum(w[3] for w in wanted) / size)


@pytest.mark.parametrize("size", [16, 1024])
def test_pack(spark, tokenizer, size):
    docs = [(i % 290 if i else None, t) for i, t in enumerate(texts())]
    frame = spark.createDataFrame([(i, t, "clash", 1.0) for i, t in docs], SCHEMA).repartition(3)
    rows = packing.pack(frame, PATH, size).collect()
    used, least = check(rows, docs, tokenizer, size)
    assert used <= least * 1.05 + 2


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_ids_are_offered(spark):
    row = packing.pack(spark.createDataFrame([(1, "a b", "", 1.0)], SCHEMA), PATH, with_ids=True).collect()[0]
    assert zlib.crc32(row.ids) == row.ids_crc32 and len(row.ids) == 4 * row.length


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_the_histogram(seed):
    random.seed(seed)
    size = 64
    histogram = np.zeros(size + 1, np.int64)
    for _ in range(4000):
        histogram[random.choice([random.randint(1, size), random.randint(1, 9), size - 3, 40])] += 1
    groups, found = packing.plan(histogram), np.zeros(size + 1, np.int64)
    for lengths, times in groups:
        assert sum(lengths) <= size and times > 0
        for length in lengths:
            found[length] += times
    assert (found == histogram).all()
    total = (histogram * np.arange(size + 1)).sum()
    large = histogram[size // 2 + 1 :].sum()  # no two of these share a sequence
    assert sum(t for _, t in groups) <= max(math.ceil(total / size), large) * 1.02 + 1


def test_before_task(spark):
    rows = [(task, length, task + length) for task in (0, 1, 5, 1500, 4000) for length in (1, 2)]
    got = packing.before_task(spark.createDataFrame(rows, "task int, length long, n long")).collect()
    for r in got:
        assert r.before == sum(n for t, k, n in rows if k == r.length and t < r.task)


def test_long_runs_of_blanks(spark, tokenizer):
    """Runs on which the faster library fails, alone, inside a text and of other blanks."""
    texts = [" " * 1_000_000, "a" + " " * 1_000_000 + "b", "\n" * 300_000 + "c", "x " * 200_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pieces(docs, PATH, with_ids=True).collect()
    for i, text in enumerate(texts):
        ids = b"".join(r.ids for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece))
        wanted = tokenizer.encode(text, add_special_tokens=False).ids + [packing.END]
        assert ids == np.array(wanted, "<u4").tobytes()
    packed = packing.pack(docs, PATH).collect()
    assert sum(r.length for r in packed) == sum(len(r.ids) // 4 for r in rows)

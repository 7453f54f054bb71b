"""The conversation trie against a plain version: members of every prefix, and totals summed down the tree."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from plain import WORD
from pyspark.sql import functions as F

from lexivec.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, place int, depth string, node int, n int, slice long"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    members = defaultdict(list)
    length = {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        turns = own.get(base, [])[:h] + own[c][h:]
        length[c] = len(turns)
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)

    def totals(k):
        below = [totals(x) for x in children[k]]
        tokens = (len(members[k]) - 1) * len(WORD.findall(k[-1][1])) if k else 0
        return sum(b[0] for b in below) or 1, tokens + sum(b[1] for b in below)

    out = []
    for k, who in members.items():
        ends = ",".join(str(c) for c in who if length[c] == len(k))
        parent = members[k[:-1]][0] if k else None
        out.append((who[0], len(k), parent, len(who), len(children[k]), *totals(k), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    table = spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], SCHEMA).repartition(3)
    got = trie.prefix_trie(*trie.regrafted(trie.numbered_turns(table))).select(*COLUMNS)
    return sorted((tuple(r) for r in got.collect()), key=str)


def conversations(n):
    random.seed(n)
    texts = ["a", "b c", "", None, "x\ty z", "w " * 2000]
    rows = [(0, t, "user", random.choice(texts)) for t in range(45)]
    for c in [*range(-25, 0), *range(1, n)]:
        rows += [(c, t if t else None, random.choice(["user", "assistant", None]), random.choice(texts)) for t in range(random.randint(1, 5))]
    rows += [(None, 0, "user", "a"), *[(7, 3, "user", "b c")] * 2, *[(c, t, "u", "same") for c in range(200, 240) for t in range(4)]]
    return rows


@pytest.mark.parametrize("part", [4096, 3])
def test_trie(spark, monkeypatch, part):
    """Shared beginnings, a long chain, turnless conversations, nulls, ties; also with prefixes summed in small parts."""
    monkeypatch.setattr(trie, "SLICE", part)
    monkeypatch.setattr(trie, "IDS", part)
    rows = conversations(60)
    assert found(spark, rows) == plain(rows)


def test_small_tables(spark):
    for rows in ([], [(None, 1, "user", "a")], [(3, None, None, None)], [(20, 0, "user", "a"), (21, 0, "user", "a")]):
        assert found(spark, rows) == plain(rows)


def test_contraction_of_a_long_chain(spark):
    """A chain of 600 nodes with a leaf at every seventh: rounds grow with the logarithm, totals are exact."""
    chain = [(0, d, None if d == 0 else (0, d - 1)) for d in range(600)]
    leaves = [(1, d + 1, (0, d)) for d in range(0, 600, 7)]
    children = defaultdict(int)
    for _, _, parent in chain + leaves:
        children[parent] += 1
    rows = [((c, d), p, children[(c, d)], int(not children[(c, d)]), c + d) for c, d, p in chain + leaves]
    node = "struct<conv_id: long, depth: long>"
    table = spark.createDataFrame(rows, f"node {node}, parent {node}, n long, leaves long, tokens long")
    got = {tuple(r.node): (r.leaves, r.tokens) for r in trie.subtree_totals(table.withColumn("n", F.col("n"))).collect()}
    for c, d, _ in chain + leaves:
        below = [(x, y) for x, y, _ in chain + leaves if (x, y) == (c, d) or (c == 0 and (y > d if x == 0 else y - 1 >= d))]
        assert got[c, d] == (sum(children[b] == 0 for b in below), sum(x + y for x, y in below))
    assert len(got) == len(rows)

"""The Merkle manifest against a plain version, and each level climbed alone against several at once."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lexivec.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree int, page string, leaf int, siblings int, step int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climbs(hashes):
    """The siblings of each leaf, level by level, and the last hash."""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        runs = [hashes[i : i + 3] for i in range(0, len(hashes), 3)]
        for j, place in enumerate(at):
            run, own = divmod(place, 3)
            paths[j].append((runs[run][:own], runs[run][own + 1 :]))
            at[j] = run
        hashes = [digest(*run) for run in runs]
    return paths, hashes[0]


def plain(rows):
    sources = {}
    for doc_id, text, lang, source, n in rows:
        changed = text
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
            changed = text.replace("\n", "")
        leaf, bad = (digest(*map(field, (doc_id, source, lang, n, t))) for t in (text, changed))
        sources.setdefault(source, []).append((doc_id, leaf, bad))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    ranked = [sorted(sources[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1:])) for s in order]
    inner = [climbs([leaf for _, leaf, _ in leaves]) for leaves in ranked]
    upper, root = climbs([subroot for _, subroot in inner]) if inner else ([], None)
    out = []
    for leaves, (paths, subroot), above in zip(ranked, inner, upper, strict=True):
        for (doc_id, leaf, folded), path in zip(leaves, paths, strict=True):
            met = ""
            for before, after in path + above:
                met += "".join(before + after)
                folded = digest(*before, folded, *after)
            out.append((doc_id, leaf, subroot, root, digest(met), folded))
    return sorted(out, key=str)


def built(spark, rows, **options):
    table = spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], SCHEMA).repartition(3)
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    changed = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle.manifest(table, {"text": changed}, **options)
    proof = F.sha2(merkle.shown(F.col("siblings")), 256)
    return sorted((tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root").collect()), key=str)


def documents(n, sources):
    random.seed(n)
    texts = ["a\nb", "x", None, "", "é\n\n", "line\n" * 3000]
    rows = [
        (i if i % 50 else None, random.choice(texts), random.choice(["en", None]), random.choice(sources), i % 7 or None) for i in range(n)
    ]
    return rows + rows[:3]


@pytest.mark.parametrize("stride", [1, 2, 5])
def test_manifest(spark, stride):
    """A large source over several stored levels, small ones, one without a name, repeated rows and ids."""
    rows = documents(420, ["s1"] * 30 + ["zz", "É", None] + [f"q{k}" for k in range(12)])
    assert built(spark, rows, stride=stride) == plain(rows)


@pytest.mark.parametrize("n", [0, 1, 4, 10])
def test_small_tables(spark, n):
    rows = [(i, "a\n", "en", "s", 1) for i in range(n)]
    assert built(spark, rows) == plain(rows)


def test_only_tampered_rows_fail(spark):
    rows = [(i, "line\n" if i % 2 else "no break", None, f"s{i % 4}", 5) for i in range(60)]
    for doc_id, _, _, root, _, folded in built(spark, rows):
        assert (folded != root) == (doc_id % 2 == 1 and zlib.crc32(str(doc_id).encode()) % 2 == 0)

"""The pipeline and the registered queries: SQL on the smallest tables, and a plain version of every stage."""

import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from plain import benchmark_hits, near_duplicates, quality, similar_lines
from tokenizers import Tokenizer

import corpus_pipeline
from checks.compare import connect, difference
from lexivec.llm import packing
from lexivec.llm.quality import QualityRules
from lexivec.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the test tables are absent")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert difference(got, connect(FOLDER).execute(ORACLES[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_returns_all_documents(spark, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas()
    if name == "op4_secret_scan":
        assert set(got.doc_id) <= set(documents.doc_id) and len(got)
    else:
        assert set(got.doc_id) == set(documents.doc_id)
    if name == "op9_language_id":
        held = got.merge(documents, on="doc_id")
        expected = [zlib.crc32(str(d).encode()) % 4 == 2 for d in held.doc_id]
        assert (held.held_out == expected).all()
        assert (held.lang == held.lang_pred)[held.held_out].mean() > 0.95


def test_stages_one_by_one(spark):
    """Each stage against its plain version, on what the stage before really kept."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, FOLDER)
        if name == "packing":
            break
        assert docs.columns == COLUMNS
        after = {r.doc_id: r for r in docs.collect()}
        assert all(r.n_chars == len(r.text) for r in after.values())
        texts = {d: r.text for d, r in before.items()}
        if name == "quality rules":
            judged = quality([(d, r.text, r.source) for d, r in before.items()], QualityRules())
            kept = {d: without(t, judged[d, t][7]) for d, t in texts.items() if judged[d, t][6]}
        elif name == "line dedup":
            removed = similar_lines(texts.items())
            cut = {d: without(t, removed.get(d, [])) for d, t in texts.items()}
            kept = {d: t for d, t in cut.items() if d not in removed or t.split()}
        elif name == "near duplicates":
            kept = {d: texts[d] for d in set(near_duplicates(texts.items()).values())}
        else:
            hits = benchmark_hits(texts.items(), [(r.item_id, r.text) for r in benchmark])
            kept = {d: texts[d] for d, _, hit, _ in hits if not hit}
        assert {d: r.text for d, r in after.items()} == kept
        docs = spark.createDataFrame([tuple(r) for r in after.values()], docs.schema)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check_packing(docs.collect(), before, tokenizer)


def without(text, removed):
    return "\n".join(line for n, line in enumerate(text.split("\n")) if n not in set(removed))


def check_packing(rows, docs, tokenizer):
    wanted, used = set(), {}
    for d, r in docs.items():
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids + [2]
        for n, (start, length) in enumerate(packing.cut(len(ids), 1024)):
            wanted.add((d, n, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())))
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == wanted and len(rows) == len(wanted)
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        ends = [0]
        for offset, length in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 1024


def test_run(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())

"""Quality rules, line dedup, near duplicates and decontamination against plain versions on planted cases."""

import random
import re
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plain import base_spans, benchmark_hits, near_duplicates, quality, similar_lines

from lexivec.llm import decontam, line_dedup, near_dup, pii
from lexivec.llm.components import components
from lexivec.llm.quality import QualityRules, clean_documents, quality_rules

SCHEMA = "doc_id long, text string, source string, set string, line int, removed string, kept boolean, sketch int"


def frame(spark, docs):
    """Documents with extra columns whose names the operators use themselves."""
    rows = [(d, t, h, "x", 1, "y", False, 2) for d, t, h in docs]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def vocabulary(n=60):
    random.seed(3)
    return ["".join(random.choice("abcdeéß") for _ in range(random.randint(2, 7))) for _ in range(n)]


def corpus():
    """Random documents, exact and near copies, shared lines, and odd ones."""
    random.seed(11)
    words = vocabulary(400)
    line = lambda k: " ".join(random.choice(words) for _ in range(k))
    shared, docs = line(12), []
    for i in range(40):
        docs.append("\n".join([line(random.randint(3, 30)) for _ in range(random.randint(1, 6))] + [shared] * (i % 3 == 0)))
    base = line(90).split()
    for i in range(25):  # a chain of near copies
        docs.append(" ".join(base))
        base[(7 * i) % 90] = random.choice(words)
    docs += [docs[0]] * 4 + [docs[1].upper(), docs[2].replace(" ", "\t")]
    docs += [None, "", " \n\t ", "one", "one two three", "one two three", "One Two  three", "a b c d e", "a b c d e f", "x " * 3000]
    out = [(i, d, f"h{i % 2}" if i % 5 else None) for i, d in enumerate(docs)]
    return [*out, out[0], out[5]]  # rows that repeat


def test_near_duplicates(spark):
    docs = corpus()
    wanted = near_duplicates({d: t for d, t, _ in docs}.items())
    got = near_dup.near_duplicates(frame(spark, docs)).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: r.component_id for r in got} == wanted
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = near_dup.deduplicated(frame(spark, docs))
    assert {r.doc_id for r in kept.collect()} == set(wanted.values()) and kept.columns == frame(spark, docs).columns


def test_near_duplicates_without_id_or_rows(spark):
    got = near_dup.near_duplicates(frame(spark, [(None, "a b c", None), (1, "a b c", None), (None, "a b c", None)])).collect()
    assert sorted((r.doc_id is None, r.component_id, r.kept) for r in got) == [(False, 1, True), (True, None, True), (True, None, True)]
    assert near_dup.near_duplicates(frame(spark, [])).collect() == []


def test_one_row_of_each_component_stays(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = [(1, a, "h"), (1, a, "h"), (1, b, "h"), (None, a + " end", "h"), (2, b + " end", "g"), (3, "other text", "h"), (4, "", "h")]
    docs += [(None, "no id", "h"), (None, "no id", "h"), (None, "no id", "g"), (None, None, None), (None, None, None)]
    left = near_dup.deduplicated(frame(spark, docs))
    got = sorted(((r.doc_id, r.text, r.source) for r in left.collect()), key=str)
    wanted = [(1, a, "h"), (1, b, "h"), (3, "other text", "h"), (4, "", "h"), (None, "no id", "g"), *[(None, None, None)] * 2]
    assert got == sorted(wanted, key=str) and left.columns == frame(spark, docs).columns
    judged = near_dup.near_duplicates(frame(spark, docs)).collect()
    assert {(r.doc_id, r.component_id) for r in judged} == {(1, 1), (2, 1), (3, 3), (4, 4), (None, None)}


def test_many_near_copies_are_not_paired(spark):
    """A large group of near copies of one text is one component."""
    random.seed(2)
    words = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(words[:i] + ["zz"] + words[i + 1 :]) if i else " ".join(words), "h") for i in range(120)]
    got = near_dup.near_duplicates(frame(spark, docs)).collect()
    assert {r.component_id for r in got} == {0}


def middling(n, length, changed):
    """Texts that differ from one base, and more from each other."""
    random.seed(9)
    base = [f"w{i}" for i in range(length)]
    texts = []
    for i in range(n):
        words = list(base)
        for k in random.sample(range(length), changed):
            words[k] = f"x{i}-{k}"
        texts.append(" ".join(words))
    return texts


def counted(monkeypatch, module, name):
    """The numbers of pairs that are handed over for verification."""
    seen, real = [], getattr(module, name)

    def count(pairs, *args):
        seen.append(pairs.count())
        return real(pairs, *args)

    monkeypatch.setattr(module, name, count)
    return seen


def test_a_group_of_middling_similarity_is_hardly_verified(spark, monkeypatch):
    """Copies of one text that resemble each other by 0.6 are no links, and few of their pairs are compared in full."""
    docs = [(i, t, "h") for i, t in enumerate([*middling(60, 150, 4), "u v w x y z", "u v w x y z"])]
    seen = counted(monkeypatch, near_dup, "verified")
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame(spark, docs)).collect()}
    assert got == near_duplicates((d, t) for d, t, _ in docs)
    assert len(set(got.values())) > 40 and sum(seen) < 100  # of 1,770 pairs


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 3000), st.integers(0, 400), st.integers(0, 400), st.integers(0, 2**32))
def test_parity_never_differs_more_than_the_sets(both, left, right, seed):
    own = np.random.default_rng(seed).integers(0, 2**64 - 1, both + left + right, np.uint64)
    a, b = np.unique(own[: both + left]), np.unique(np.concatenate([own[:both], own[both + left :]]))
    apart = int(np.bitwise_count((near_dup.parity(a) ^ near_dup.parity(b)).view(np.uint64)).sum())
    assert apart <= len(np.setxor1d(a, b)) and (apart - len(np.setxor1d(a, b))) % 2 == 0


def test_minhash_estimates_similarity():
    random.seed(5)
    words = [str(random.random()) for _ in range(800)]
    a, b = near_dup.shingle_set(" ".join(words[:600])), near_dup.shingle_set(" ".join(words[100:700]))
    shared = len(np.intersect1d(a, b))
    wanted = shared / (len(a) + len(b) - shared)
    found = (near_dup.signature(a, 4096) == near_dup.signature(b, 4096)).mean()
    assert abs(found - wanted) < 0.03


def test_components(spark):
    random.seed(8)
    links = [(i, i + 1) for i in range(60) if i % 20 != 19] + [(100 + i, 100) for i in range(30)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(got[i] == i // 20 * 20 for i in range(60))
    assert all(got[100 + i] == 100 for i in range(30))
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_line_dedup(spark):
    docs = list({d: (d, t, h) for d, t, h in corpus()}.values())
    wanted = similar_lines([(d, t) for d, t, _ in docs])
    rows = line_dedup.dedup_lines(frame(spark, docs)).collect()
    assert {r.doc_id: [x.line for x in r.removed] for r in rows if r.removed} == wanted
    for r in rows:
        assert all((x.match_doc, x.match_line) < (r.doc_id, x.line) for x in r.removed)


def test_long_lines_of_middling_similarity_are_hardly_paired(spark, monkeypatch):
    """Lines of 120 words that share 100 or so are no links, also if the words they do not share are the frequent ones."""
    random.seed(4)
    texts = [re.sub(r"x\S+", lambda _: f"c{random.randrange(400)}", t) for t in middling(50, 120, 20)]
    frequent = "\n".join(" ".join([f"c{k}"] * 100) for k in range(400))  # lines of one word are not compared
    docs = [(i, t, "h") for i, t in enumerate([*texts, "a b c d e", "e d c b a", frequent])]
    seen = counted(monkeypatch, line_dedup, "_verified")
    rows = line_dedup.dedup_lines(frame(spark, docs)).collect()
    assert {r.doc_id: [x.line for x in r.removed] for r in rows if r.removed} == similar_lines((d, t) for d, t, _ in docs)
    assert sum(seen) < 300  # of 1,225 pairs


def test_line_dedup_shuffles_no_text_that_is_not_asked_for(spark, tmp_path):
    frame(spark, [(1, "a b c d e", "h"), (2, "e d c b a", "h")]).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    plan = line_dedup.dedup_lines(docs).select("doc_id", "removed")._jdf.queryExecution().optimizedPlan().toString()
    keyed = [line for line in plan.split("\n") if "AS _l_key#" in line]
    assert keyed and not any(re.search(r"[\[ ]text#\d+[,\]]", line) for line in keyed)
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("line_words_")] == []
    folder = Path(spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:"))
    assert not list(folder.glob("line_words_*"))


def test_line_links_are_all_found(spark):
    """Thirty near copies and three exact ones: every pair is a link, not one per line."""
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words[:i] + ["zz"] + words[i + 1 :]) for i in range(30)] + [" ".join(words)] * 3 + ["a b c d e"]
    docs = frame(spark, [(i, t, "h") for i, t in enumerate(texts)])
    sets = [frozenset(t.split()) for t in texts]
    near = [[100 * len(a & b) >= 85 * len(a | b) for b in sets] for a in sets]
    got = {r.doc.id: r for r in line_dedup.count_links(docs).collect()}
    assert {d: r.n_links for d, r in got.items()} == {i: sum(row) - 1 for i, row in enumerate(near)}
    assert {d: (r.class_doc.id, r.class_line) for d, r in got.items()} == {i: (sets.index(s), 0) for i, s in enumerate(sets)}
    _, pairs = line_dedup.line_links(docs)
    assert pairs.count() == 31 * 30 // 2


def test_line_dedup_cleans(spark):
    five = "a b c d e"
    docs = [(None, f"{five}\nshort", None), (1, f"new one\n{five}\n\nE D C B A", None), (2, five, None), (3, None, None), (4, "", None)]
    docs += [(5, "k l m n o p q", None), (5, "k l m n o p q", None)]
    cleaned = line_dedup.clean_documents(frame(spark, docs))
    assert cleaned.columns == frame(spark, docs).columns
    got = sorted(((r.doc_id, r.text) for r in cleaned.collect()), key=str)
    assert got == sorted([(None, f"{five}\nshort"), (1, "new one\n"), (3, None), (4, ""), *[(5, "k l m n o p q")] * 2], key=str)
    assert line_dedup.dedup_lines(frame(spark, [])).collect() == []


def test_line_dedup_tells_rows_of_one_id_apart(spark):
    """Lines are compared and removed row by row, without an id and with a repeated one."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(8)) for x in "abcd")
    docs = [(None, f"{a}\n{b}", "h"), (None, f"{c}\n{d}", "h"), (7, f"{a}\nown line", "h"), (7, f"other line\n{d}", "h"), (8, c, "h")]
    got = sorted(((r.doc_id, r.text) for r in line_dedup.clean_documents(frame(spark, docs)).collect()), key=str)
    assert got == sorted([(None, docs[0][1]), (None, docs[1][1]), (7, "own line"), (7, "other line")], key=str)


def test_quality_rules(spark):
    rules = QualityRules(min_words=4, max_documents=3)
    docs = corpus()
    wanted = quality(docs, rules)
    got = quality_rules(frame(spark, docs), rules).collect()
    assert len(got) == len(docs)
    texts = {d: t or "" for d, t, _ in docs}
    for r in got:
        found = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.removed_lines)
        assert found == wanted[r.doc_id, texts[r.doc_id]]
    assert any(r.removed_lines for r in got)


def test_quality_cleans(spark):
    rules = QualityRules(min_words=1, max_documents=2, max_repeat_percent=100)
    docs = [(i, f"common line\nown {chr(97 + i)} words here", "h") for i in range(5)] + [(None, None, None), (9, "", "h")]
    cleaned = clean_documents(frame(spark, docs), rules)
    got = sorted((r.doc_id, r.text) for r in cleaned.collect())
    assert got == [(0, docs[0][1])] + [(i, f"own {chr(97 + i)} words here") for i in range(1, 5)]
    assert quality_rules(frame(spark, [])).collect() == []


def test_the_line_limit_does_not_grow_with_the_host(spark):
    """A line of 21 texts is removed and one of 20 stays, in a host of 50 texts and in one of 5,000."""
    for size in (50, 5_000):
        own = " ".join(f"word{i}" for i in range(60))
        docs = [(i, f"{own} nr {chr(97 + i % 26)}{i}x\n" + ("often seen" if i < 21 else "less seen" if i < 41 else ""), "h") for i in range(size)]
        docs = [(i, t.replace("nr ", f"{'y' * (i % 70)} "), h) for i, t, h in docs]
        got = quality_rules(frame(spark, docs)).filter("size(removed_lines) > 0").select("doc_id", "removed_lines").collect()
        assert sorted((r.doc_id, r.removed_lines) for r in got if 1 in r.removed_lines) == [(i, [1]) for i in range(1, 21)]


BENCHMARK = [
    (1, "The quick brown fox jumps over the lazy dog and runs away"),
    (2, "short item"),
    (3, "one"),
    (None, "unnamed short thing"),
    (4, None),
    (5, "!!"),
    (20, "quick brown fox jumps over the lazy dog and runs away again"),
    (6, "a a a a a a a a a a a"),
]


def contaminated():
    return [
        (1, "so THE quick-brown fox jumps over the lazy dog, and that", "h"),
        (2, "x quick brown fox jumps over the lazy dog and runs away y", "h"),
        (3, "a " * 40 + "b", "h"),
        (4, "this is a short item, and one more; unnamed short thing", "h"),
        (5, None, None),
        (6, "", None),
        (7, "étéone one été", "h"),
        (None, "short item", "h"),
        (1, "clean text", "h"),
        (1, "clean text", "h"),
    ]


@pytest.mark.parametrize("limit", [decontam.GROUP_BYTES, 600])
def test_decontamination(spark, limit):
    docs, items = contaminated(), spark.createDataFrame(BENCHMARK, "item_id long, text string")
    got = decontam.contaminated_spans(frame(spark, docs), items, max_group_bytes=limit).collect()
    found = [(r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), sorted(r["items"])) for r in got]
    wanted = benchmark_hits([(d, t) for d, t, _ in docs], [(i, t) for i, t in BENCHMARK if i is not None])
    unnamed = benchmark_hits([(d, t) for d, t, _ in docs], BENCHMARK)
    merged = [(d, n, hit, own) for (d, n, _, own), (_, _, hit, _) in zip(wanted, unnamed, strict=True)]
    assert sorted(found, key=str) == sorted(merged, key=str)
    left = decontam.clean_documents(frame(spark, docs), items, max_group_bytes=limit)
    assert left.columns == frame(spark, docs).columns
    bad = {d for d, _, hit, _ in merged if hit}
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted((d for d, _, _ in docs if d not in bad), key=str)


@pytest.mark.parametrize("limit", [decontam.GROUP_BYTES, 600])
def test_decontamination_keeps_clean_rows(spark, limit):
    """A hit in one row leaves the other rows without an id, and by row those of the same id."""
    docs = [*contaminated(), (None, "clean text", "h"), (None, None, "h")]
    items = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    clean = [(None, "clean text"), (None, None)]
    left = decontam.clean_documents(frame(spark, docs), items, max_group_bytes=limit)
    got = [(r.doc_id, r.text) for r in left.collect()]
    assert sorted(got, key=str) == sorted([*clean, (5, None), (6, "")], key=str)
    left = decontam.clean_documents(frame(spark, docs), items, by_row=True, max_group_bytes=limit)
    got = [(r.doc_id, r.text) for r in left.collect()]
    assert sorted(got, key=str) == sorted([*clean, (5, None), (6, ""), *[(1, "clean text")] * 2], key=str)


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {len(r.spans) for r in decontam.contaminated_spans(frame(spark, contaminated()), none).collect()} == {0}
    assert decontam.contaminated_spans(frame(spark, []), none).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60), st.integers(1, 6), st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=9), max_size=4))
def test_search_finds_every_occurrence(words, size, items):
    matcher = decontam.Matcher([(i, b" ".join(x).decode()) for i, x in enumerate(items)], size)
    spans, found = matcher.find(words)
    (_, _, hit, own) = benchmark_hits([(0, b" ".join(words).decode())], [(i, b" ".join(x).decode()) for i, x in enumerate(items)], size)[0]
    assert sum(b - a for a, b in spans) == hit and found == own


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("1204.@+-() a_%é"), max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == base_spans(text)


def test_base_spans_of_long_runs():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "4111 " * 50_000):
        pii.base_spans(text)
    assert pii.base_spans("0" * 5000 + ".1.2.3") == [(0, 5006, "ip")]
    assert pii.base_spans("0" * 5000 + "256.1.2.3") == []


def test_personal_data_of_long_zeros(spark):
    docs = [(1, "0" * 5000 + ".1.2.3", "h"), (2, None, "h"), (3, "", "h"), (None, "a@b.cd", None)]
    rows = pii.personal_data(frame(spark, docs), pii.train(frame(spark, docs))).collect()
    assert {(r.doc_id, r.n_ip, r.n_email) for r in rows} == {(1, 1, 0), (2, 0, 0), (3, 0, 0), (None, 0, 1)}
    none = frame(spark, [])
    assert pii.personal_data(none, pii.train(none)).collect() == []

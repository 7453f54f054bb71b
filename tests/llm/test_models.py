"""Learned operators: exact parts against plain versions, learned parts by held-out accuracy or planted cases."""

import math
import random

import numpy as np
import pytest
from plain import base_spans
from pyspark.sql import functions as F

from lexivec.llm import chat, langid, pii, secrets, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, score double, tags string, label int, start long"


def frame(spark, docs):
    """Documents (doc_id, text, lang) with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, lang, "a/b", 0.5, "t", 1, 7) for d, t, lang in docs], SCHEMA).repartition(2)


ODD = [(900, None, None), (901, "", "xx"), (902, " \n", None), (903, "12 34 !!", None), (None, "plain words", None), (904, "w " * 20_000, None)]


# Chats


def fold(events):
    """A log by hand: conv_id to [(turn, role, text)]."""
    chats, roles = {}, {}
    for c, _, turn, kind, role, text in sorted(events, key=lambda e: e[1]):
        own = chats.setdefault(c, {})
        old = own.get(turn, ("", ""))[1]
        old_role = roles.get((c, turn), "")  # also of a message that was dropped
        named = role if role is not None else old_role
        if kind in ("message", "delta"):
            roles[c, turn] = named
        if kind == "message":
            own[turn] = (named, text or "")
        elif kind == "delta":
            own[turn] = (named, old + (text or ""))
        elif kind == "edit":
            own[turn] = (old_role, text or "")
        elif kind == "regenerate":
            for later in [t for t in own if t > turn]:
                del own[later]
            own[turn] = (old_role, "")
    return {c: [(t, *m) for t, m in sorted(own.items())] for c, own in chats.items() if own}


def logs():
    random.seed(4)
    events, seq = [], 0
    tricky = ["</s>", "[ROLE]", "[/ROLE]", "\\", "\\l", "<", "\n", "é😀", "[INST] ok [/INST]", "", None, "word "]
    for c in (1, 2, 3, None):
        for turn in range(1, 6):
            seq += 1
            events.append((c, seq, turn, "message", ("user", "assistant")[turn % 2], random.choice(tricky)))
            for _ in range(random.randint(0, 4)):
                seq += 1
                events.append((c, seq, turn, random.choice(["delta", "delta", "edit"]), None, random.choice(tricky)))
            if random.random() < 0.3:
                seq += 1
                events.append((c, seq, random.randint(1, turn), "regenerate", None, None))
                seq += 1
                events.append((c, seq, events[-1][2], "delta", None, "again"))
    return [*events, (4, 1, 1, "unknown", "user", "x"), (5, 1, 1, "delta", None, "only </s> delta")]


def test_logs_are_folded_and_read_back(spark):
    events = logs()
    table = spark.createDataFrame(events, "conv_id long, seq long, turn long, kind string, role string, text string")
    wanted = fold([e for e in events if e[3] != "unknown"])
    formatted = chat.format_chats(table)
    texts = {r.conv_id: r for r in formatted.collect()}
    assert set(texts) == set(wanted)
    back = {}
    for r in chat.read_back(formatted).collect():
        back.setdefault(r.conv_id, []).append((r.message, r.role, r.text, r.learned))
    for c, own in wanted.items():
        rows = sorted(back[c], key=lambda x: x[0])
        assert [(role, text) for _, role, text, _ in rows] == [(role, text) for _, role, text in own]
        assert [x for *_, x in rows if x is not None] == [text for _, role, text in own if role == "assistant"]
        assert [texts[c].formatted[s.start : s.end].count("<") for s in texts[c].loss_spans] == [0] * len(texts[c].loss_spans)


def test_repeated_turns_are_messages_of_their_own(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", None), (2, 0, None, "x")]
    log = chat.log_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = sorted(tuple(r) for r in chat.messages(log).select("conv_id", "role", "text").collect())
    assert got == [(1, "assistant", ""), (1, "user", "a"), (1, "user", "a"), (2, "", "x")]
    assert chat.format_chats(log.filter("conv_id > 5")).collect() == []


# Toxicity


def test_ordinal_gradient_fits_known_thresholds():
    rng = np.random.default_rng(1)
    n, weights, cuts = 6000, np.array([2.0, -1.5, 0.0]), np.array([0.5, 1.8])
    present = rng.random((n, 3)) < 0.4
    noise = rng.logistic(size=n)
    grades = ((present @ weights + noise)[:, None] > cuts).sum(axis=1)
    rows, columns = np.nonzero(present)
    found_cuts, found = toxicity.fit(grades, rows, columns, 3)
    assert np.abs(found - weights).max() < 0.25 and np.abs(found_cuts - cuts).max() < 0.25
    assert (np.diff(found_cuts) > 0).all()


def test_severity_of_planted_documents(spark):
    random.seed(9)
    words = ["".join(random.choice("abcdefgh") for _ in range(4)) for _ in range(200)]
    bad = ["nastyword", "vileword", "awfulword", "meanword"]
    docs, labels = [], []
    for i in range(400):
        grade = random.choice([0, 0, 0, 1, 2])
        text = [random.choice(words) for _ in range(40)] + random.sample(bad, 2 * grade)
        random.shuffle(text)
        docs.append((i, " ".join(text), "en"))
        labels.append((i, grade, "clash"))
    table = spark.createDataFrame(labels, "doc_id long, grade int, text string")
    known = table.filter("doc_id < 300").union(spark.createDataFrame([(None, 2, ""), (7000, 1, ""), (1, None, "")], table.schema))
    model = toxicity.train(frame(spark, docs), known)
    got = {r.doc_id: r for r in toxicity.severity(frame(spark, docs + ODD), model).collect()}
    assert len(got) == len(docs) + len(ODD)
    held = [(got[i], g) for i, g, _ in labels if i >= 300]
    assert np.mean([r.toxic == (g > 0) for r, g in held]) > 0.95
    means = [np.mean([r.severity for r, g in held if g == k]) for k in range(3)]
    assert means[0] < 0.3 < means[1] < means[2]
    assert not any(got[d].toxic for d, _, _ in ODD)


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, grade int")
    model = toxicity.train(frame(spark, ODD), none)
    assert {(r.severity, r.toxic) for r in toxicity.severity(frame(spark, ODD), model).collect()} == {(0.0, False)}


# Languages


@pytest.fixture(scope="module")
def tongues():
    random.seed(6)
    made = {}
    for name, letters in {"aa": "abcde", "bb": "cdefg", "cc": "xyzéa"}.items():
        made[name] = ["".join(random.choice(letters) for _ in range(random.randint(2, 6))) for _ in range(80)]
    return [(i, " ".join(random.choice(made[n]) for _ in range(30)).upper(), n) for i, n in enumerate(sorted(made) * 40)]


def test_language_of_held_out_texts(spark, tongues):
    filters = langid.learn(frame(spark, [*tongues[:90], *ODD]))
    got = {r.doc_id: r for r in langid.identify(frame(spark, tongues[90:] + ODD), filters).collect()}
    assert all(got[d].lang_pred == lang for d, _, lang in tongues[90:])
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[d].lang_pred for d in (900, 901, 902, 903)] == ["und"] * 4 and got[None].lang_pred in ("aa", "bb", "cc")


def test_filters_hold_every_trigram_and_more_than_64_languages():
    random.seed(3)
    names = [f"l{i}" for i in range(70)]
    cells = np.zeros((2, 1 << langid.CELL_BITS), np.uint64)
    texts = [chr(0x4E00 + 50 * i) * 3 + chr(0x4E01 + 50 * i) * 4 for i in range(70)]
    for i, text in enumerate(texts):
        for at in langid.probes(langid.trigrams(langid.code_points(text))):
            cells[i // 64, at] |= np.uint64(1) << np.uint64(i % 64)
    assert langid.Filters(names, cells).predict(texts)[0] == names


def test_nothing_learned(spark):
    filters = langid.learn(frame(spark, []))
    assert {r.lang_pred for r in langid.identify(frame(spark, ODD), filters).collect()} == {"und"}


# Personal data


def private_documents():
    random.seed(12)
    words = ["anon", "there", "is", "thing", "of", "mail", "Or"]
    filler = lambda: " ".join(random.choice(words) for _ in range(random.randint(3, 40)))
    number = lambda k: "".join(random.choice("0123456789") for _ in range(k))

    def card():
        start = number(15)
        return next(start + c for c in "0123456789" if pii.luhn(start + c))

    kinds = [
        lambda: f"{number(2)}@mail{number(1)}.example.com",
        lambda: ".".join(str(random.randint(0, 255)) for _ in range(4)),
        card,
        lambda: f"+1 ({number(3)}) 555-{number(4)}",
    ]
    return [(i, f"{filler()} {kinds[i % 4]()} {filler()} {number(random.randint(1, 6))}\n{filler()}", "en") for i in range(240)]


def test_network_gradient_and_learning(spark):
    docs = private_documents()
    tagger = pii.train(frame(spark, docs), max_windows=600)
    held = private_documents()[::5]
    found = tagger.spans([t for _, t, _ in held])
    base = [pii.base_spans(t) for _, t, _ in held]
    right = sum(set(b) <= set(f) for b, f in zip(base, found, strict=True))
    assert right > 0.85 * len(held)
    # A phone without its sign is no base span; the network adds it.
    text = "anon there is thing 1 (415) 555-2671 of mail there"
    added = [b for _, b in pii.all_spans([text] * 3, tagger)]
    assert all(any(k == "phone" for _, _, k in b) for b in added)

    got = {r.doc_id: r for r in pii.personal_data(frame(spark, docs + ODD), tagger).collect()}
    for d, t, _ in docs + ODD:
        own = base_spans(t or "")
        row = got[d]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == x for *_, k in own) for x in pii.KINDS]
        listed = set(row.spans.split(",")) if row.spans else set()
        assert {f"{k}:{s}:{e}" for s, e, k in own} <= listed and row.n_added == len(listed) - len(own)


def test_gradient_of_the_network():
    rng = np.random.default_rng(2)
    tagger = pii.Tagger(3)
    tagger.weights = {k: v.astype(float) for k, v in tagger.weights.items()}
    classes, tags = rng.integers(0, pii.CLASSES, (7, 2)), rng.integers(0, pii.TAGS, (7, 2))
    _, grads = tagger.gradient(classes, tags)
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, values = tagger.weights[name][at], []
        for step in (1e-4, -1e-4):
            tagger.weights[name][at] = old + step
            values.append(tagger.gradient(classes, tags)[0])
        tagger.weights[name][at] = old
        assert math.isclose(g[at], (values[0] - values[1]) / 2e-4, rel_tol=1e-2)


def test_spans_over_window_borders():
    tagger = pii.Tagger()
    tagger.decode = lambda classes: np.where(classes == 1, 2, 0)  # every digit is inside an email
    for lead in range(0, 200, 7):
        text = "a" * lead + "1" * 60 + "b" * 30
        assert tagger.spans([text, "no anchor", ""]) == [[(lead, lead + 60, "email")], [], []]


def test_no_training_windows(spark):
    assert pii.train(frame(spark, [ODD[0], ODD[1]])) is None
    assert len(pii.personal_data(frame(spark, ODD), None).collect()) == len(ODD)


# Secrets


def secret_documents():
    random.seed(13)
    hexes = lambda k: "".join(random.choice("0123456789abcdef") for _ in range(k))
    docs = []
    for i in range(60):
        kind = i % 4
        middle = [f'token = "{hexes(40)}"', f"{random.randint(10**15, 10**16 - 1)}", "averyverylongplainword", "nothing here"][kind]
        docs.append((i, f"wörds {i} before {middle} after é", "en"))
    return docs


def test_secrets_are_told_from_long_words(spark):
    docs = secret_documents()
    got = secrets.scan(frame(spark, docs + ODD), dictionary_count=2).collect()
    texts = {d: t for d, t, _ in docs}
    assert len(got) == 45
    for r in got:
        assert texts[r.doc_id][r.start : r.end] == r.candidate
        assert r.is_secret == (r.doc_id % 4 == 0)


def test_secrets_with_given_labels(spark):
    docs = secret_documents()
    labels = spark.createDataFrame([("averyverylongplainword", 1), ("nothing", 0)] + [(t.split('"')[1], 0) for d, t, _ in docs if d % 4 == 0], "candidate string, label int")
    got = secrets.scan(frame(spark, docs), labels, dictionary_count=2)
    assert {r.candidate for r in got.filter("is_secret").collect()} >= {"averyverylongplainword"}
    assert not got.filter(F.col("is_secret") & F.col("candidate").rlike("^[0-9a-f]{40}$")).count()


def test_secrets_of_odd_documents(spark):
    assert secrets.scan(frame(spark, ODD)).collect() == []
    one = secrets.scan(frame(spark, [(1, "\u0001abcdefghijklmnop12345 x abcdefghijklmnop12345", None)] * 2)).collect()
    assert sorted((r.start, r.end, r.score, r.is_secret) for r in one) == [(1, 22, None, False)] * 2 + [(25, 46, None, False)] * 2

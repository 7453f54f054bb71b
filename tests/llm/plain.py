"""Plain Python versions of the operators, one document after the other."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}


def near_duplicates(docs, percent=75):
    """{doc_id: smallest id reachable}"""
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def similar_lines(docs, percent=85, least=5):
    """{doc_id: numbers of removed lines}, for ids without repeats."""
    lines = []
    for d, text in sorted(docs, key=lambda x: (x[0] is not None, x[0])):
        for n, line in enumerate((text or "").split("\n")):
            words = frozenset(WORD.findall(line.lower()))
            if len(words) >= least:
                lines.append((d, n, words))
    removed = defaultdict(list)
    for i, (d, n, words) in enumerate(lines):
        if any(100 * len(words & w) >= percent * len(words | w) for _, _, w in lines[:i]):
            removed[d].append(n)
    return dict(removed)


def quality(docs, rules):
    """{(doc_id, text): (words, word_chars, symbols, dup_lines, repeat_words, base_failed, kept, removed lines)} of (doc_id, text, host)."""
    holders = defaultdict(set)

    def normal(line):
        return re.sub("[0-9]+", "0", re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" "))

    for d, text, host in docs:
        for line in (text or "").split("\n"):
            if WORD.search(line):
                holders[host or "", normal(line)].add((text or "", d))
    out = {}
    for d, text, host in docs:
        text, host = text or "", host or ""
        words, lines = WORD.findall(text), text.split("\n")
        worded = [x for x in lines if WORD.search(x)]
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        times = Counter(grams)
        hit = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
        removed = []
        for n, line in enumerate(lines):
            if WORD.search(line):
                who = holders[host, normal(line)]
                texts = len({t for t, _ in who})
                first = min(w[1] for w in who)
                if texts > rules.max_documents and d != first:
                    removed.append(n)
        left = len(words) - sum(len(WORD.findall(lines[n])) for n in removed)
        failed = len(words) < rules.min_words or 100 * len(hit) > rules.max_repeat_percent * len(words)
        out[d, text] = (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(worded) - len(set(worded)), len(hit),
            failed, not failed and left >= rules.least_left * len(words), removed,
        )
    return out


def benchmark_hits(docs, items, size=10):
    """[(doc_id, words, hit words, items)]"""
    split = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+").findall
    windows = defaultdict(set)
    for item, text in items:
        words = split((text or "").translate(LOWER))
        for i in range(max(len(words) - size + 1, 1) if words else 0):
            windows[tuple(words[i : i + size])].add(str(item))
    out = []
    for d, text in docs:
        words, hit, found = split((text or "").translate(LOWER)), set(), set()
        for length in {len(w) for w in windows}:
            for i in range(len(words) - length + 1):
                own = windows.get(tuple(words[i : i + length]))
                if own:
                    hit |= set(range(i, i + length))
                    found |= own
        out.append((d, len(words), len(hit), sorted(found)))
    return out


def base_spans(text):
    """Personal data by the patterns as they are written."""
    found = [(m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append((m.start(), "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        number = [int(c) for c in m.group() if c.isdigit()]
        double = [d * 2 - 9 * (d > 4) if i % 2 else d for i, d in enumerate(reversed(number))]
        if 12 <= len(number) <= 19 and sum(double) % 10 == 0:
            found.append((m.start(), "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append((m.start(), "phone", m.end()))
    order = ["email", "ip", "card", "phone"]
    return [(s, e, k) for s, k, e in sorted(found, key=lambda x: (x[0], order.index(x[1])))]

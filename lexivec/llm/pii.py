"""Personal data: fixed patterns, and a character BiLSTM with CRF transitions that adds further spans.

Base spans are the leftmost non-overlapping matches of four patterns, found in time linear in the text.
The network is trained in numpy on windows around labelled spans, and read over overlapping windows: each
character's tag comes from the window in whose middle it lies, so spans are reconciled over the whole text.

An added span must hold a digit or an `@` and pass the checks of its kind (`plausible`). Windows without
either character are therefore not read: all their characters are outside any span.

Training windows come from the texts themselves: those around base spans and around other digits, and,
so that the network learns to add, copies of them with the sign of a phone dropped or the separators of a
card changed. At most `max_windows` windows are used (those with the smallest hash); the bound is a parameter.

Defined cases: null and empty texts have no spans. Offsets are code points, ends exclusive. An added span
that overlaps a base span or an earlier added one is dropped. Without training windows only base spans are
returned. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.shared import saved

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
WINDOW, STRIDE = 96, 48
MAX_WINDOWS = 1200
HIDDEN = 12
Span = tuple[int, int, str]

# Possessive forms of the contract's patterns: they match the same spans without backtracking over runs.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANCHOR = re.compile(r"[0-9@]")
_DIGIT = re.compile(r"[0-9]")


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(number)):
        d = int(c) * (1 + place % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def is_card(text: str) -> bool:
    number = digits(text)
    return 12 <= len(number) <= 19 and luhn(number)


def emails(text: str) -> Iterator[Span]:
    free, at = 0, text.find("@")
    before = -1  # the last @ before this one
    while at >= 0:
        low = max(free, before + 1)
        start = low + len(text[low:at].rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end(), "email"
            free = found.end()
        before = at
        at = text.find("@", max(free, at + 1))


def base_spans(text: str) -> list[Span]:
    found: list[Span] = list(emails(text))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m.group().split("."))):
                found.append((m.start(), m.end(), "ip"))
        found += [(m.start(), m.end(), "card") for m in _CARD.finditer(text) if is_card(m.group())]
        found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def plausible(text: str, kind: str) -> bool:
    """Whether a span that the network found may be personal data of this kind."""
    number = digits(text)
    if kind == "email":
        local, at, domain = text.replace(" ", "").partition("@")
        return bool(at and local and "." in domain.strip("."))
    if kind == "ip":
        parts = text.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return is_card(text)
    return 9 <= len(number) <= 15 and any(c in " ().-" for c in text)


# The network


def char_classes(text: str) -> np.ndarray:
    """A small number per character: ASCII punctuation as it is, digits, letters and others as classes."""
    points = np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 128)
    return _CLASS[points]


def _classes() -> np.ndarray:
    table, following = np.zeros(129, np.int64), 5
    for c in range(128):
        char = chr(c)
        if char.isdigit():
            table[c] = 1
        elif char.isupper():
            table[c] = 2
        elif char.islower():
            table[c] = 3
        elif char.isspace():
            table[c] = 4
        else:
            table[c] = following
            following += 1
    return table


_CLASS = _classes()
CLASSES = int(_CLASS.max()) + 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Character classes to tag scores by two LSTMs, and tag sequences by a linear-chain CRF."""

    def __init__(self, hidden: int = HIDDEN, seed: int = 5):
        rng, scale = np.random.default_rng(seed), 0.3
        new = lambda *shape: rng.normal(0, scale, shape).astype(np.float32)
        self.hidden = hidden
        self.weights = {"out": new(2 * hidden, TAGS), "bias": np.zeros(TAGS, np.float32), "next": np.zeros((TAGS, TAGS), np.float32)}
        for side in "fb":
            self.weights |= {f"in_{side}": new(CLASSES, 4 * hidden), f"again_{side}": new(hidden, 4 * hidden)}

    def _run(self, classes: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, batch, hidden) of one direction; gates are kept for training."""
        first, again, h = self.weights[f"in_{side}"], self.weights[f"again_{side}"], self.hidden
        length, batch = classes.shape
        out = np.zeros((length, batch, h), np.float32)
        state = cell = np.zeros((batch, h), np.float32)
        for t in range(length) if side == "f" else range(length - 1, -1, -1):
            z = first[classes[t]] + state @ again
            gates, new = _sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
            old, before = cell, state
            cell = gates[:, h : 2 * h] * cell + gates[:, :h] * new
            bent = np.tanh(cell)
            state = gates[:, 2 * h :] * bent
            out[t] = state
            if keep is not None:
                keep.append((t, gates, new, old, before, bent))
        return out

    def scores(self, classes: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """(time, batch, tags) for classes (time, batch)."""
        sides = [self._run(classes, s, None if keep is None else keep.setdefault(s, [])) for s in "fb"]
        both = np.concatenate(sides, axis=2)
        if keep is not None:
            keep["both"] = both
        return both @ self.weights["out"] + self.weights["bias"]

    def decode(self, classes: np.ndarray) -> np.ndarray:
        """The best tags (time, batch)."""
        scores, link = self.scores(classes), self.weights["next"]
        best, back = scores[0], []
        for t in range(1, len(scores)):
            paths = best[:, :, None] + link
            back.append(paths.argmax(axis=1))
            best = paths.max(axis=1) + scores[t]
        tags = [best.argmax(axis=1)]
        for pointers in reversed(back):
            tags.append(pointers[np.arange(len(tags[-1])), tags[-1]])
        return np.array(tags[::-1])

    def gradient(self, classes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of a batch, and its gradient."""
        keep: dict = {}
        scores, link = self.scores(classes, keep), self.weights["next"]
        length, batch, _ = scores.shape
        here = np.arange(batch)
        ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
        ahead[0] = scores[0]
        total = lambda x, axis: np.log(np.exp(x - (m := x.max(axis=axis, keepdims=True))).sum(axis=axis)) + m.squeeze(axis)
        for t in range(1, length):
            ahead[t] = total(ahead[t - 1][:, :, None] + link, 1) + scores[t]
        for t in range(length - 2, -1, -1):
            behind[t] = total(link + (scores[t + 1] + behind[t + 1])[:, None, :], 2)
        norm = total(ahead[-1], 1)
        d_scores = np.exp(ahead + behind - norm[:, None])
        d_link = np.zeros_like(link)
        gold = np.zeros(batch)
        for t in range(length):
            gold += scores[t][here, tags[t]]
            d_scores[t][here, tags[t]] -= 1
            if t:
                pair = ahead[t - 1][:, :, None] + link + (scores[t] + behind[t])[:, None, :] - norm[:, None, None]
                d_link += np.exp(pair).sum(axis=0)
                gold += link[tags[t - 1], tags[t]]
                np.subtract.at(d_link, (tags[t - 1], tags[t]), 1)
        d_scores /= batch
        grads = {
            "next": d_link / batch,
            "bias": d_scores.sum(axis=(0, 1)),
            "out": np.einsum("tbh,tbk->hk", keep["both"], d_scores),
        }
        d_both, h = d_scores @ self.weights["out"].T, self.hidden
        for k, side in enumerate("fb"):
            again = self.weights[f"again_{side}"]
            d_in, d_again = np.zeros_like(self.weights[f"in_{side}"]), np.zeros_like(again)
            d_state = d_cell = np.zeros((batch, h), np.float32)
            for t, gates, new, old, before, bent in reversed(keep[side]):
                enter, forget, leave = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
                d_state = d_state + d_both[t][:, k * h : (k + 1) * h]
                d_cell = d_cell + d_state * leave * (1 - bent**2)
                d_gates = np.concatenate([d_cell * new, d_cell * old, d_state * bent], axis=1) * gates * (1 - gates)
                d_z = np.concatenate([d_gates, d_cell * enter * (1 - new**2)], axis=1)
                np.add.at(d_in, classes[t], d_z)
                d_again += before.T @ d_z
                d_state, d_cell = d_z @ again.T, d_cell * forget
            grads |= {f"in_{side}": d_in, f"again_{side}": d_again}
        return float((norm - gold).mean()), grads

    def fit(self, classes: np.ndarray, tags: np.ndarray, steps: int = 300, batch: int = 48, rate: float = 0.02, seed: int = 5) -> None:
        """Adam over batches of windows (window, time)."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for step in range(1, steps + 1):
            part = rng.integers(0, len(classes), batch)
            _, grads = self.gradient(classes[part].T, tags[part].T)
            for name, g in grads.items():
                g = np.clip(g, -5, 5)
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                move = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6)
                self.weights[name] = (self.weights[name] - rate * move).astype(np.float32)

    def spans(self, texts: list[str]) -> list[list[Span]]:
        """Spans of each text, before any check, from overlapping windows."""
        places, parts = [], []
        for number, text in enumerate(texts):
            anchors = {m.start() // STRIDE for m in _ANCHOR.finditer(text)}
            if not anchors:
                continue
            classes = np.concatenate([char_classes(text), np.full(2 * WINDOW, 4)])
            # Window k covers [k * STRIDE, k * STRIDE + WINDOW), so an anchor in cell c is in windows c - 1 and c.
            for k in sorted({max(c + d, 0) for c in anchors for d in (-1, 0)}):
                places.append((number, k))
                parts.append(classes[k * STRIDE : k * STRIDE + WINDOW])
        tags = {}
        for start in range(0, len(parts), 1024):
            decoded = self.decode(np.array(parts[start : start + 1024]).T).T
            tags |= dict(zip(places[start : start + 1024], decoded, strict=True))
        whole: dict[int, dict[int, np.ndarray]] = {}
        margin = (WINDOW - STRIDE) // 2
        for (number, k), own in tags.items():
            low = 0 if k == 0 else margin
            whole.setdefault(number, {})[k * STRIDE + low] = own[low : margin + STRIDE]
        return [self._joined(whole.get(n, {}), len(text)) for n, text in enumerate(texts)]

    @staticmethod
    def _joined(pieces: dict[int, np.ndarray], length: int) -> list[Span]:
        """Spans of the tag pieces; a span goes on over a border if the next piece follows and is inside it."""
        found, opened, kind, end = [], -1, 0, -1
        for start in sorted(pieces):
            for at, tag in enumerate(pieces[start].tolist(), start):
                if at >= length:
                    break
                inside = tag and opened >= 0 and tag % 2 == 0 and (tag - 1) // 2 == kind and at == end
                if inside:
                    end = at + 1
                    continue
                if opened >= 0:
                    found.append((opened, end, KINDS[kind]))
                    opened = -1
                if tag:
                    opened, kind, end = at, (tag - 1) // 2, at + 1
        if opened >= 0:
            found.append((opened, end, KINDS[kind]))
        return found


def all_spans(texts: list[str], tagger: Tagger | None) -> list[tuple[list[Span], list[Span]]]:
    """Base spans, and base and added spans together, of each text."""
    base = [base_spans(t) for t in texts]
    added = tagger.spans(texts) if tagger else [[] for _ in texts]
    out = []
    for text, own, more in zip(texts, base, added, strict=True):
        taken = sorted((s, e) for s, e, _ in own)
        starts = np.array([s for s, _ in taken])
        reach = np.maximum.accumulate([e for _, e in taken]) if taken else np.zeros(0)
        kept, last = [], -1
        for start, end, kind in more:
            while start < end and text[start] in " ,;:":
                start += 1
            while end > start and text[end - 1] in " ,;:.-":
                end -= 1
            at = int(np.searchsorted(starts, end))
            free = at == 0 or reach[at - 1] <= start
            if free and start >= last and plausible(text[start:end], kind):
                kept.append((start, end, kind))
                last = end
        out.append((own, in_order(own + kept)))
    return out


# Training windows


def _windows_of(text: str) -> Iterator[tuple[str, bytes]]:
    """Windows (text, tags) around base spans, changed copies of them, and around other digits."""
    spans, seen = base_spans(text), set()

    def cut(text: str, spans: list[Span], middle: int) -> tuple[str, bytes]:
        low = max(0, min(middle - WINDOW // 2, len(text) - WINDOW))
        tags = np.zeros(WINDOW, np.uint8)
        for start, end, kind in spans:
            a, b = max(start - low, 0), min(end - low, WINDOW)
            if a < b:
                tags[a:b] = 2 + 2 * KINDS.index(kind)
                if start >= low:
                    tags[a] -= 1
        return text[low : low + WINDOW].ljust(WINDOW), tags.tobytes()

    for start, end, kind in spans:
        yield cut(text, spans, (start + end) // 2)
        seen |= {start // WINDOW, end // WINDOW}
        own = text[start:end]
        changed = own[1:] if kind == "phone" else re.sub("(?<=[0-9]{4})[ -]?(?=[0-9])", ".", own, count=3) if kind == "card" else own
        if changed != own:
            near = text[max(0, start - WINDOW) : start]
            copy = near + changed + text[end : end + WINDOW]
            yield cut(copy, [(len(near), len(near) + len(changed), kind)], len(near) + len(changed) // 2)
    for cell in sorted({m.start() // WINDOW for m in _ANCHOR.finditer(text)} - seen):
        yield cut(text, spans, cell * WINDOW + WINDOW // 2)


def train(docs: DataFrame, text: str = "text", max_windows: int = MAX_WINDOWS, **options) -> Tagger | None:
    """A tagger from a bounded sample of the windows of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                found = [w for t in batch.column(0).slice(start, 200).to_pylist() for w in _windows_of(t)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t for t, _ in found], pa.string()), pa.array([b for _, b in found], pa.binary())], names=["text", "tags"]
                )

    some = docs.select(F.col(text).alias("text")).filter(F.col("text").rlike("[0-9@]"))
    windows = some.mapInArrow(run, "text string, tags binary").distinct()
    # Half of the windows at most are without a span.
    with_span = F.hex("tags").rlike("[1-9]")
    picked = [
        windows.filter(keep).orderBy(F.xxhash64("text", "tags"), "text").limit(max_windows // 2).toArrow().to_pylist()
        for keep in (with_span, ~with_span)
    ]
    rows = picked[0] + picked[1]
    if not picked[0]:
        return None
    tagger = Tagger()
    classes = np.array([char_classes(r["text"]) for r in rows])
    tagger.fit(classes, np.array([np.frombuffer(r["tags"], np.uint8) for r in rows]).astype(np.int64), **options)
    return tagger


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def personal_data(docs: DataFrame, tagger: Tagger | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: base counts and their digest, all spans, and the number of added ones."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                found = all_spans([t or "" for t in part.column(1).to_pylist()], shared.value)
                counts = [pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
                digests = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found])
                spans = pa.array([joined(every) for _, every in found])
                added = pa.array([len(every) - len(base) for base, every in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *counts, digests, spans, added],
                    names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
                )

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, SCHEMA)

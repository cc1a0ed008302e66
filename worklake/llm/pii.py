"""Personal data: candidates from high-recall generators, judged by gradient-boosted trees.

Four base kinds follow fixed patterns and are always spans. Further generators propose overlapping
candidates (assigned secrets, dense tokens, digit groups, disguised addresses, account numbers). Trees
score each by its format and the words around; a candidate is a span if its score, calibrated on
held-out rows, says at least PRECISION.

The trees learn from weak labels: candidates that a strict format proves (base kinds, keys of known
form, assignments of dense values) against ordinary words and digit groups that no format fits. They are
fitted on up to TRAIN candidates of each label, those with the smallest hashes over all documents; all
else runs on every text.

Null text is empty and has no spans. Rows are judged one by one, repeated or not. Offsets count code
points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklake.llm.hashing import mix

BASE = ("email", "ip", "card", "phone")
MORE = ("secret", "number", "address", "account")
KINDS = BASE + MORE
#: Labelled candidates of each class used for fitting and calibration.
TRAIN = 10_000
PRECISION = 0.9
ROUNDS, DEPTH, BINS, RATE = 40, 3, 32, 0.2

# The base patterns. A local part or a number starts where its run does, or where the
# last match ended, so that a long run without a match is read once.
_LOCAL, _DOMAIN = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
EMAIL = regex.compile(rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_DOMAIN}+(?:\.{_DOMAIN}+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_WORDS = r"(?:password|passwd|passwort|pwd|token|secret|api[_-]?key|access[_-]?key|auth|bearer)"
ASSIGNED = re.compile(rf"(?i)(?<![a-z0-9]){_WORDS}\s{{0,3}}[:=]\s{{0,3}}[\"']?([^\s\"']{{6,}}+)")
DENSE = re.compile(r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{12,}+")
GROUPS = re.compile(r"(?<![0-9A-Za-z.,])[+(]?[0-9][0-9 ().-]{5,30}[0-9](?![0-9A-Za-z])")
# Between labels; a dot with one space beside it may end a sentence, so it counts after the first label only.
_DOT = r"(?:\.|\s\.\s|\s?(?:\[dot\]|\(dot\))\s?)"
DISGUISED = re.compile(
    rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}\s?(?:\[at\]|\(at\))\s?{_DOMAIN}++"
    rf"(?:(?:{_DOT}{_DOMAIN}++)*{_DOT}|\s?\.\s?)[A-Za-z]{{2}}{_DOMAIN}*+(?:{_DOT}{_DOMAIN}++)*+"
)
ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
ORDINARY = re.compile(r"[^\W\d_]{4,}")
_HINT = re.compile(r"[0-9@=:\[(]")
_KEY = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,}")
_CONTEXT = [
    re.compile(rf"(?i){p}")
    for p in (_WORDS, r"phone|tel\b|tel\.|mobil|fax|call", r"card|visa|konto|iban|account|credit", r"mail|contact", r"version|section|page|chapter|isbn|issn|no\.")
]
AROUND = 32


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds, in order."""
    out = []
    if "@" in text:
        out += [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _digits(m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) that the generators propose; they may overlap."""
    out = []
    for kind, pattern, group in ((4, ASSIGNED, 1), (4, DENSE, 0), (5, GROUPS, 0), (6, DISGUISED, 0), (7, ACCOUNT, 0)):
        for m in pattern.finditer(text):
            if pattern is DENSE and m.group().isalpha() and not m.group().isupper():
                continue  # a plain word
            out.append((m.start(group), kind, m.end(group)))
    return sorted(set(out))


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    """Format of a candidate, then its context."""
    s = text[start:end]
    n = len(s)
    counts = Counter(s)
    digits = sum(counts[c] for c in "0123456789")
    upper, lower = sum(c.isupper() for c in s), sum(c.islower() for c in s)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:], strict=False))
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    return [
        n, digits, digits / n, upper / n, lower / n, (n - digits - upper - lower) / n, entropy, len(counts) / n, changes / n,
        float(all(c in "0123456789abcdefABCDEF" for c in s)), float(digits > 1 and luhn(_digits(s))), len(re.split(r"[\W_]+", s)),
        float(s[0] == "+"), float("@" in s or "(at)" in s or "[at]" in s), float(s.count(".")), sum(counts[c] for c in "aeiouAEIOU") / n,
        float(kind == 4), float(kind == 5), float(kind == 6), float(kind == 7),
        float(before.endswith(("=", '="', "='", ": ", '= "', ':"'))), float(before[-1:] in ('"', "'") and after[:1] in ('"', "'")),
        float(after[:1].isalnum()), *[float(bool(p.search(before))) for p in _CONTEXT],
    ]


def weak_label(text: str, start: int, kind: int, end: int, base: list[tuple[int, int, int]]) -> int | None:
    """1 if a strict format proves the candidate, 0 if none can fit, else None."""
    s = text[start:end]
    if any(a < end and start < b for a, _, b in base) or _KEY.fullmatch(s) or kind in (6, 7):
        return 1
    mixed = any(c.isdigit() for c in s) and any(c.isalpha() for c in s)
    if kind == 4:
        assigned = _CONTEXT[0].search(text[max(0, start - AROUND) : start]) and text[max(0, start - 4) : start].strip(" \"'").endswith(("=", ":"))
        return 1 if assigned and mixed and len(set(s)) >= 6 else None if mixed else 0
    return 0 if len(_digits(s)) < 8 else None


@dataclass
class Trees:
    """Boosted regression trees for the log-odds; nodes are (feature, cut, left, right), leaves (-1, value, 0, 0)."""

    trees: list[list[tuple[int, float, int, int]]]
    scores: np.ndarray
    chances: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for tree in self.trees:
            at = np.zeros(len(x), np.int64)
            table = np.array(tree)
            for _ in range(DEPTH):
                f = table[at, 0].astype(np.int64)
                inner = f >= 0
                right = x[np.arange(len(x)), np.maximum(f, 0)] > table[at, 1]
                at = np.where(inner, np.where(right, table[at, 3], table[at, 2]).astype(np.int64), at)
            total += table[at, 1]
        return total

    def chance(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability."""
        if not len(self.scores):
            return np.zeros(len(x))
        return self.chances[np.clip(np.searchsorted(self.scores, self.score(x), "right") - 1, 0, None)]


def _grow(x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> list[tuple[int, float, int, int]]:
    nodes: list = [None]
    todo = [(0, np.arange(len(x)), DEPTH)]
    while todo:
        at, rows, depth = todo.pop()
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, -1, 0.0)
        if depth and len(rows) >= 20:
            for f, edges in enumerate(cuts):
                if not len(edges):
                    continue
                bins = np.searchsorted(edges, x[rows, f], "left")
                lg = np.cumsum(np.bincount(bins, g[rows], len(edges) + 1))[:-1]
                lh = np.cumsum(np.bincount(bins, h[rows], len(edges) + 1))[:-1]
                gain = lg**2 / (lh + 1) + (total_g - lg) ** 2 / (total_h - lh + 1) - total_g**2 / (total_h + 1)
                k = int(gain.argmax())
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), f, float(edges[k]))
        if best[1] < 0:
            nodes[at] = (-1, RATE * total_g / (total_h + 1), 0, 0)
            continue
        right = x[rows, best[1]] > best[2]
        nodes[at] = (best[1], best[2], len(nodes), len(nodes) + 1)
        nodes += [None, None]
        todo += [(nodes[at][2], rows[~right], depth - 1), (nodes[at][3], rows[right], depth - 1)]
    return nodes


def _rising(y: np.ndarray) -> np.ndarray:
    """The nearest values that never fall (pooled adjacent violators)."""
    pools: list[list[float]] = []
    for v in y:
        pools.append([float(v), 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b = pools.pop()
            a = pools[-1]
            pools[-1] = [(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1]]
    return np.concatenate([np.full(int(n), v) for v, n in pools]) if pools else np.zeros(0)


def train(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees from the even rows, calibrated on the odd ones. Both need both labels, else nothing is accepted."""
    fit, hold = slice(0, None, 2), slice(1, None, 2)
    if min(len(set(y[fit].tolist())), len(set(y[hold].tolist()))) < 2:
        return Trees([], np.zeros(0), np.zeros(0))
    xs, ys = x[fit], y[fit].astype(float)
    cuts = [np.unique(np.quantile(xs[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    model, total = Trees([], np.zeros(0), np.zeros(0)), np.zeros(len(xs))
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-total))
        model.trees.append(_grow(xs, cuts, ys - p, p * (1 - p)))
        total = model.score(xs)
    s = model.score(x[hold])
    order = np.lexsort((y[hold], s))
    values, first = np.unique(s[order], return_index=True)
    chances = _rising(y[hold][order].astype(float))
    last = np.r_[first[1:], len(s)] - 1
    model.scores, model.chances = values, chances[last]
    return model


N_FEATURES = len(features("x1", 0, 4, 2))


def fit(docs: DataFrame, limit: int = TRAIN) -> Trees:
    """Trees for the corpus, from up to `limit` labelled candidates of each class."""

    def labelled(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = text or ""
                if _HINT.search(text):
                    base = base_spans(text)
                    for start, kind, end in candidates(text):
                        label = weak_label(text, start, kind, end, base)
                        if label is not None:
                            rows.append((doc_id, start, kind, label, features(text, start, kind, end)))
                elif m := ORDINARY.search(text, len(text) // 2):  # an ordinary word, under each kind in turn
                    kind = 4 + m.start() % 4
                    rows.append((doc_id, m.start(), kind, 0, features(text, m.start(), kind, m.end())))
            if rows:
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _LABELLED.types, strict=True)], schema=_LABELLED)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.mapInArrow(labelled, "doc_id long, start long, kind int, label int, f array<double>")
    order = [F.xxhash64("doc_id", "start", "kind"), "doc_id", "start", "kind", F.xxhash64("f")]
    both = [rows.filter(F.col("label") == k).orderBy(*order).limit(limit) for k in (0, 1)]
    found = both[0].unionByName(both[1]).select("doc_id", "start", "kind", "label", "f").collect()
    if not found:
        return Trees([], np.zeros(0), np.zeros(0))
    x = np.array([r.f for r in found], float)
    y = np.array([r.label for r in found])
    keys = np.array([((r.doc_id or 0) * 1_000_003 + r.start * 8 + r.kind) & ((1 << 63) - 1) for r in found], np.uint64)
    order = np.lexsort((*x.T, y, mix(keys)))
    return train(x[order], y[order])


_LABELLED = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("kind", pa.int32()), ("label", pa.int32()), ("f", pa.list_(pa.float64()))])


def spans(text: str, model: Trees) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: those and the accepted candidates, without those that lie within longer ones.

    Spans may overlap: what an accepted candidate holds is covered to its last character.
    """
    if not _HINT.search(text):
        return [], []
    base = base_spans(text)
    held = bytearray(len(text))
    for start, _, end in base:
        held[start:end] = b"\1" * (end - start)
    free = [c for c in candidates(text) if 0 in held[c[0] : c[2]]]
    if not free:
        return base, base
    chance = model.chance(np.array([features(text, *c) for c in free], float))
    taken: list[tuple[int, int, int]] = []
    for k in sorted(range(len(free)), key=lambda k: (free[k][0] - free[k][2], -chance[k], free[k])):
        c = free[k]
        if chance[k] >= PRECISION and 0 in held[c[0] : c[2]]:
            held[c[0] : c[2]] = b"\1" * (c[2] - c[0])
            taken.append(c)
    return base, sorted(base + taken)


def _written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def redact(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by the name of its first."""
    out, at, end = [], 0, 0
    for start, kind, stop in found:
        if start >= end:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        end = at = max(end, stop)
    return "".join(out) + text[at:]


def report(docs: DataFrame) -> DataFrame:
    """One row a document: counts of the base kinds, hash of the base spans, all spans."""
    model = fit(docs)
    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_more"]

    def judged(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                base, found = spans(text or "", model)
                kinds = Counter(kind for _, kind, _ in base)
                sha = hashlib.sha256(_written(base).encode()).hexdigest()
                rows.append((doc_id, *(kinds[k] for k in range(4)), sha, _written(found), len(found) - len(base)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k not in (5, 6) else pa.string()) for k, c in enumerate(zip(*rows, strict=True))], names=names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(judged, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_more long")


def clean(docs: DataFrame) -> DataFrame:
    """`docs` with the spans in `text` replaced; texts without any stay as they are."""
    model = fit(docs)
    at = docs.columns.index("text")
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # names of any kind

    def cleaned(batches):
        for batch in batches:
            texts = [t if t is None else redact(t, spans(t, model)[1]) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return plain.mapInArrow(cleaned, plain.schema).toDF(*docs.columns)

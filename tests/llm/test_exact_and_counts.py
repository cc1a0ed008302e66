"""Exact dedup, tokenizer alignment and collocations against plain versions, on odd rows and past their limits."""

import collections
import hashlib
import re

import numpy as np
import pytest

from worklake.llm import alignment, collocations, exact_dedup, tokens

FOLDER = "/root/testdata/sf0.001"
A, B = tokens.vocabulary("byte_bpe_50k.json"), tokens.vocabulary("piece_bpe_32k.model")
LONG = " ".join(f"w{k * 7919 % 100003}" for k in range(800_000))  # over 4 MB
PLAIN = "the quick brown fox jumps over the lazy dog, again and again. " * 40
ROWS = [
    (1, "a  b\tc", "en"), (2, "a b c", "en"), (2, "a b c", "en"), (None, "a\nb\nc", None), (None, "a b c", "en"),
    (3, None, "en"), (4, "", None), (5, " ", "en"), (6, "\n\t ", "en"), (7, " a b c", "en"), (8, "one", "xx"),
    (9, LONG, "en"), (10, PLAIN + " ", "en"), (11, "." * 50_000, "en"), (12, "x" * 70_000, ""), (13, PLAIN, "en"), (14, PLAIN, "en"),
    (15, "a  b c　 d  e", "en"), (16, "▁ sign", "en"), (17, "<|endoftext|> <s> <0x0A> \x00 \U0001f600 日本", "en"),
    (18, "\n\n  lead and trail \r\n\t", "en"), (19, "it's  we'll 3.14,15 é ﻿x", "de"), (20, PLAIN.upper(), "en"),
    (21, "the quick brown;fox " * 50, None),
]
SCHEMA = "doc_id long, text string, lang string, r long, n int, `a.b` int, norm string, g int, w long, f int, id int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 7, 1, 2, "x", 3, 4, 5, 6) for r in ROWS], SCHEMA)


def groups_plainly(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    ids = collections.defaultdict(list)
    for i, t in rows:
        ids[norm(t)].append(i)
    out = []
    for t, members in ids.items():
        known = sorted(i for i in members if i is not None)
        digest = hashlib.sha256(t.encode()).hexdigest()
        for k, i in enumerate(known + [None] * members.count(None)):
            out.append((i, known[0] if known else None, len(members), k == 0, digest))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [exact_dedup.MAX_BITS, 8])
def test_exact_dedup(docs, monkeypatch, most):
    """Also where the bitmap is so small that all its bits are set."""
    monkeypatch.setattr(exact_dedup, "LEAST_BITS", min(most, exact_dedup.LEAST_BITS))
    real = exact_dedup.hashed
    monkeypatch.setattr(exact_dedup, "hashed", lambda *a, **k: real(*a, most=most, **k))
    want = groups_plainly([r[:2] for r in ROWS])
    assert sorted(map(tuple, exact_dedup.report(docs).collect()), key=str) == want
    kept = exact_dedup.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in want if r[3])


def test_only_surviving_groups_are_hashed_whole(docs):
    rows = exact_dedup.hashed(docs, id=docs.doc_id).collect()
    repeated = {r[0] for r in groups_plainly([r[:2] for r in ROWS]) if r[2] > 1}
    assert {r.id for r in rows if r.full is not None} == repeated


def alignment_plainly(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    byte = {c: k for k, c in enumerate(tokens._letters())}
    spelt = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in a.get_vocab().items()}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    out, count, best = [], collections.Counter(), collections.Counter()
    for d, t in rows:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        raw = (" " + (t or "")).encode()
        if b"".join(spelt[i] for i in x) != raw or b"".join(map(piece, y)) != raw:
            out.append((d, 0, 0, []))
            continue
        ends = dict(zip(np.cumsum([len(spelt[i]) for i in x]).tolist(), range(len(x)), strict=True))
        groups, u, v, at = [], 0, 0, 0
        for k, i in enumerate(y):
            at += len(piece(i))
            if at in ends:
                groups.append((x[u : ends[at] + 1], y[v : k + 1]))
                u, v = ends[at] + 1, k + 1
        count.update((p[-1], q[-1]) for p, q in groups)
        out.append((d, len(x), len(y), groups))
    for (_, q), n in count.items():
        best[q] = max(best[q], n)
    told = []
    for d, n_a, n_b, groups in out:
        links = [(p[-1], q[-1]) for p, q in groups]
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        told.append((
            d, n_a, n_b, len(groups), len(links), sum(count[k] == best[k[1]] for k in links), sum(count[k] for k in links),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return sorted(told, key=str)


def test_alignment(spark):
    given = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    want = alignment_plainly(map(tuple, given.collect()))
    assert sorted(map(tuple, alignment.report(given.repartition(5), A, B).collect()), key=str) == want
    assert sum(r[3] for r in want) > 100_000


def test_alignment_of_odd_rows(docs):
    got = alignment.report(docs, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = alignment_plainly([r[:2] for r in ROWS])
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert {r[0]: r[1] for r in want}[16] == 0 and {r[0]: r[1] for r in want}[17] > 0


def test_table_of_segments_starts_anew():
    texts = [" " + t for _, t, _ in ROWS if t]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    roomy, tight = alignment.Segments(A, B), alignment.Segments(A, B)
    want = [(x[0].tolist(), *x[1:]) for x in roomy.rows(raw, at)]
    tight.held = alignment.TABLE_BYTES + 1
    assert [(x[0].tolist(), *x[1:]) for x in tight.rows(raw, at)] == want
    tight.second[: tight.n] ^= np.uint64(1)  # as if all were other segments of the same hash
    assert [(x[0].tolist(), *x[1:]) for x in tight.rows(raw, at)] == want


def test_identity_map_prefers_pieces():
    assert alignment.identity_map([b"a", b" b", b"\n", b"", b"zz"], [b"a", b"a", b" b", b"\n"], [True, False, False, True]).tolist() == [1, 2, 3, -1, -1]


def collocations_plainly(rows, top, least):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = collections.Counter(), collections.Counter()
    for t, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(table)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(ws)
            for k in range(1, 5):
                f.update(("und" if lang is None else lang, *ws[i : i + k]) for i in range(len(ws) - k + 1))
    f = {g: c for g, c in f.items() if c >= least}
    most = collections.Counter()
    for (lang, *g), c in f.items():
        for k in range(1, len(g)):
            for i in range(len(g) - k + 1):
                most[lang, *g[i : i + k]] = max(most[lang, *g[i : i + k]], c)
    found = collections.defaultdict(list)
    for (lang, *g), a in f.items():
        if len(g) > 1 and 100 * most[lang, *g] < 80 * a:
            cuts = [(2_000_000 * a // (f[lang, *g[:k]] + f[lang, *g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            found[lang].append((-score, -a, " ".join(g).encode(), f[lang, *g[:k]], f[lang, *g[k:]]))
    return sorted(
        (lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, c in found.items() for i, (s, a, p, x, y) in enumerate(sorted(c)[:top])
    )


@pytest.mark.parametrize(("flush", "hot", "bits"), [(1 << 21, 1000, 1 << 27), (500, 20, 1 << 15), (5000, 10**9, 1 << 16)])
def test_collocations(spark, docs, monkeypatch, flush, hot, bits):
    """Also with many small stripes, split stripes, and bitmaps in which all bits are set."""
    monkeypatch.setattr(collocations, "FLUSH", flush)
    monkeypatch.setattr(collocations, "HOT", hot)
    monkeypatch.setattr(collocations, "MAX_BITS", bits)
    monkeypatch.setattr(collocations, "LEAST_BITS", min(bits, collocations.LEAST_BITS))
    given = spark.read.parquet(f"{FOLDER}/documents.parquet").select("text", "lang")
    rows = [r for r in map(tuple, given.collect()) if len(r[0]) % 3 or flush > 500]
    given = spark.createDataFrame(rows + [(t, x) for _, t, x in ROWS if t != LONG], "text string, lang string").repartition(6)
    want = collocations_plainly([tuple(r) for r in given.collect()], 40, 8)
    assert sorted(map(tuple, collocations.report(given, top=40, least=8).collect())) == want
    assert {r[0] for r in want} >= {"en", "und"}


def test_collocations_of_odd_rows(docs):
    got = collocations.report(docs, least=3)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == collocations_plainly([(t, x) for _, t, x in ROWS], 2000, 3)


def test_words_that_share_a_hash_are_told_apart(spark, monkeypatch):
    """Where the first hash is one and the same for all words, the next seed is taken."""
    real = collocations.spans_hash
    monkeypatch.setattr(collocations, "spans_hash", lambda raw, s, e, which=0: real(raw, s, e, which) * np.uint64(which))
    block = collocations.Words(*[np.frombuffer(b"aa bb aa", np.uint8), np.array([0, 8]), np.zeros(1, np.uint64)], 0)
    assert len(set(block.id.tolist())) == 1
    block = collocations.Words(*[np.frombuffer(b"aa bb aa", np.uint8), np.array([0, 8]), np.zeros(1, np.uint64)], 1)
    assert len(set(block.id.tolist())) == 2 and block.id[0] == block.id[2]


def test_empty_tables(docs):
    none = docs.limit(0)
    assert exact_dedup.report(none).count() == exact_dedup.keep(none).count() == 0
    assert alignment.report(none, A, B).count() == 0
    assert collocations.report(none).count() == 0

"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import re

import pytest

from worklake.llm import decontaminate, near_dedup, packing, pii, preferences, quality, records, substrings, tokens, urls, warc

WORDS = [f"word{k % 700}x{k * k % 911}" for k in range(3000)]
LONG = " ".join(f"w{k * 7919 % 100003}" for k in range(400_000))  # over 2 MB
A = " ".join(WORDS[:120])
ROWS = [
    (1, A, "en"), (1, A, "en"),  # a repeated row
    (2, A, "en"), (3, A + " tail", None),  # a copy and a near copy
    (4, " ".join(WORDS[200:300]), "en"), (4, " ".join(WORDS[400:520]), "xx"),  # one id, two texts
    (None, A, "en"), (None, None, None), (5, None, "en"), (6, "", "en"), (7, " \n\t ", "en"), (8, "one", "en"),
    (9, LONG, "en"), (10, "." * 100_000, "en"), (11, "a@" * 2000 + "1" * 50_000, "en"),
]
SCHEMA = "doc_id long, text string, lang string, d string, x string, `__m` int, row int, start int, `a.b` int, spans string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "d", "x", 1, 2, 3, 4, "s") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(1, " ".join(WORDS[40:60])), (1, "one"), (None, " ".join(WORDS[205:215])), (2, None), (3, ""), (4, "not there at all")]
    return spark.createDataFrame([(*r, 1) for r in rows], "item_id long, text string, d int")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def by_id(rows, *columns):
    return sorted((str(r["doc_id"]), *[r[c] for c in columns]) for r in rows)


def test_quality(docs):
    rows = quality.report(docs).collect()
    assert by_id(rows, "n_words") == sorted((str(i), len(words(t))) for i, t, _ in ROWS)
    assert all(r.base_failed and not r.kept for r in rows if r.n_words < 10)
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows)


def test_substrings(docs):
    rows = substrings.report(docs).collect()
    assert by_id(rows, "n_words") == sorted((str(i), len(words(t))) for i, t, _ in ROWS)
    gone = {(r.doc_id, r.n_words): r.n_removed for r in rows}
    assert gone[None, 120] == 0 and gone[1, 120] == 120 and gone[2, 120] == 120 and gone[3, 121] == 120
    assert sum(r.n_removed for r in rows if r.doc_id not in (1, 2, 3)) == 400_000 - 100_003  # LONG repeats itself


def test_near_duplicates(docs):
    rows = near_dedup.report(docs).collect()
    assert len(rows) == len(ROWS)
    label = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in rows}
    assert label[3, 120] == (1, False) and label[2, 119] == (1, False) and label[1, 119] == (1, True)
    assert label[None, 119] == (None, True) and label[5, 0] == (5, True) and label[8, 1] == (8, True)
    kept = near_dedup.keep(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 4, *range(5, 12)] and ids.count(None) == 2  # 4: unlike texts


def test_decontamination(docs, bench):
    rows = decontaminate.report(docs, bench).collect()
    assert len(rows) == len(ROWS)
    hit = {(r.doc_id, r.n_words): (r.n_hit, r.n_items) for r in rows}
    assert hit[1, 120] == hit[2, 120] == hit[None, 120] == (20, 1) and hit[8, 1] == (1, 1)
    assert hit[4, 100] == (10, 1) and hit[4, 120] == (0, 0) and hit[5, 0] == (0, 0)
    kept = decontaminate.keep(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(r.n_hit == 0 for r in rows)


def test_personal_data(docs):
    rows = pii.report(docs).collect()
    assert len(rows) == len(ROWS)
    clean = pii.clean(docs)
    assert clean.columns == docs.columns and clean.count() == len(ROWS)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_operators_on_odd_rows(docs, name):
    path = tokens.vocabulary(name)
    library = tokens.Encoder(path).library
    want = sorted((str(i), len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, _ in ROWS)
    assert by_id(records.report(docs, path).collect(), "n_tokens") == want
    pieces = packing.report(docs, path).collect()
    assert sorted((str(p.doc_id), p.doc_tokens) for p in pieces if p.start == 0) == want


def test_empty_tables(spark, docs, bench):
    none, path = docs.limit(0), tokens.vocabulary("word_bpe_49k.json")
    for out in (
        quality.report(none), quality.keep(none), pii.report(none), pii.clean(none), substrings.report(none),
        packing.report(none, path), records.report(none, path), decontaminate.report(none, bench),
        near_dedup.report(none), near_dedup.keep(none),
    ):
        assert out.count() == 0
    assert decontaminate.report(docs, bench.limit(0)).filter("contaminated").count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.report(pages).count() == 0 and warc.report(pages).count() == 0
    assert preferences.report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_pages(spark):
    rows = [
        (1, "HTTP://x", "a"), (2, None, None), (3, "https://WWW.Example.com/en/1", "a"), (3, "no scheme", "a"), (None, "http://a.net/fr/?q", "b"),
        (4, "http://cheap-pills.org#x", ""), (5, "http://a.net/es", "long " * 300_000), (6, "http://a.org://b/c", "b"),
    ]
    pages = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, kind string, file int")
    got = {(r.page_id, r.host): (r.path, r.rule, r.verdict) for r in urls.report(pages).collect()}
    assert got[3, "www.example.com"] == ("/en/1", "www.example.com/en/", "allow") and got[2, ""] == ("", None, "allow")
    assert got[None, "a.net"] == ("/fr/", "net/fr/", "block") and got[4, "cheap-pills.org"] == ("", None, "block")
    assert got[5, "a.net"] == ("/es", None, "allow") and got[6, "a.org:"] == ("//b/c", None, "allow")
    out = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.report(pages).collect())
    assert out == sorted([
        ("1", 1, "revisit", 3), ("3", 1, "response", None), ("3", 1, "response", None), ("2", 0, "revisit", 4),
        ("4", 0, "response", None), ("None", 1, "revisit", 6), ("6", 1, "response", None), ("5", 1_500_000, "response", None),
    ], key=lambda r: (r[0], r[1]))


def test_pages_with_long_urls(spark):
    urls = {1: "http://x/" + "a" * 100_000, 2: "http://x/" + "\u65e5" * 100_000, 3: "data:text/html," + "a%20" * 25_000, 4: "http://x/4"}
    pages = spark.createDataFrame([(k, u, "same" if k != 3 else "other") for k, u in urls.items()], "page_id long, url string, html string")
    out = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.report(pages).collect())
    assert out == [(1, 4, "revisit", 4), (2, 4, "revisit", 4), (3, 5, "response", None), (4, 4, "response", None)]
    one = warc.record(1, urls[1], b"x")
    for bad in (one[:-100], one[:60_000], b"WARC/1.1\r\nno colon\r\n\r\n", b"WARC/1.1\r\n", b"WARC/1.1"):
        with pytest.raises(warc.Damaged):
            warc.parse(bad)


def test_pairs(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 1, "assistant", "no"), (1, 0, "user", "hi"), (2, None, None, None),
        (4, 0, "user", "q"), (4, 0, "user", "q"), (5, 0, "assistant", "a"), (5, 1, "user", "more"), (6, 0, "assistant", None),
        (None, 0, "user", "lost"), (None, 0, "user", "lost"), (None, 1, "assistant", "x" * 100_000),
    ]
    turns = spark.createDataFrame([(*r, 7, 8) for r in rows], "conv_id long, turn long, role string, text string, pair_id int, lone int")
    out = preferences.report(turns).collect()
    got = {r.pair_id: r for r in out if r.pair_id is not None}
    assert got[0].prompt == "<|user|>\nhi<|end|>\n" and got[0].chosen == "<|assistant|>\nyes<|end|>\n"
    assert got[0].rejected == "<|assistant|>\nno<|end|>\n" and got[0].rejected_mask == "14:0,10:1" and not got[0].same
    assert got[1].same and got[1].prompt.endswith("no<|end|>\n") and got[2].prompt == "<|unknown|>\n<|end|>\n"  # no next, no assistant
    assert got[4].n_prompt_turns == 2 and got[4].same
    assert got[5].n_prompt_turns == 0 and got[5].rejected == "<|assistant|>\n<|end|>\n<|user|>\nmore<|end|>\n"
    lost = [r for r in out if r.pair_id is None]  # each turn without a conversation is one of its own
    assert sorted(len(r.prompt) for r in lost) == [21, 21, 100_022] and all(r.same and r.n_prompt_turns == 1 for r in lost)
    pairs = spark.createDataFrame([(1, "chosen", 0, "user", "a"), (1, "rejected", 0, "user", "b"), (None, "rejected", 0, "user", "c")], "pair_id long, side string, turn long, role string, text string")
    assert sorted((str(r.pair_id), r.chosen[-9:], r.rejected[-9:]) for r in preferences.format_pairs(pairs).collect()) == [("1", "a<|end|>\n", "b<|end|>\n"), ("None", "", "c<|end|>\n")]

"""Operators and the pipeline against plain versions in Python."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from worklake.llm import decontaminate, near_dedup, packing, pii, quality, records, tokens, warc

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def spans_plainly(text):
    """The base kinds as their patterns say, without shortcuts."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        out += [(m.start(), 1, m.end())] * all(int(p) <= 255 for p in m.group().split("."))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        luhn = sum(n if k % 2 == 0 else sum(divmod(2 * n, 10)) for k, n in enumerate(d)) % 10 == 0
        out += [(m.start(), 2, m.end())] * (14 <= len(d) <= 19 and luhn)
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        out += [(m.start(), 3, m.end())] * (10 <= sum(c.isdigit() for c in m.group()) <= 15)
    return sorted(out)


def test_base_spans():
    rnd = random.Random(1)
    signs = ["a", "B", "7", "12", "255", "256", "4539578763621486", "@", ".", "-", "_", "%", "+", " ", "(", ")", "+49 ", "é", "x.de", "0"]
    for _ in range(4000):
        text = "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 25)))
        assert pii.base_spans(text) == spans_plainly(text), text


def test_personal_data(docs):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in pii.report(docs).collect():
        base = spans_plainly(texts[r.doc_id])
        told = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert set(filter(None, told.split(","))) <= set(r.spans.split(","))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for _, k, _ in base) for n in range(4))


def test_secrets_are_covered_to_their_last_character(docs):
    model, rnd, plain = pii.fit(docs), random.Random(6), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for n in (201, 300, 800, 2000, 5000):
        for signs in (plain, plain + "-_.", plain + "-_.!#$%&*+/:;<=>?@^~(){}[]"):
            secret = "".join(rnd.choice(signs) for _ in range(n))
            text = f"set api_key = {secret} and go on"
            held = {k for a, _, b in pii.spans(text, model)[1] for k in range(a, b)}
            assert set(range(14, 14 + n)) <= held <= set(range(4, 14 + n))
            told = pii.redact(text, pii.spans(text, model)[1])
            assert told.endswith("> and go on") and len(told) < 60


def test_disguised_addresses_are_whole():
    for address in (
        "a (at) mail.example.com", "a.b[at]x.example.co.uk", "a (at) mail [dot] example [dot] com", "a(at)mail(dot)1x(dot)com", "a (at) e.x.org",
        "a (at) mail . example . com", "a (at) x. com", "a (at) x.museum1.c0m", f"a (at) {'x' * 63}.{'y' * 63}.example",
    ):
        for text in (address, f"to {address}. Then we", f"({address}), and"):
            start = text.index(address)
            assert (start, 6, start + len(address)) in pii.candidates(text), text
    assert not pii.DISGUISED.search("at 5 (at) 10.5 or so")


def test_trees_learn_and_leave_ordinary_words():
    rnd = random.Random(2)
    hexes = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    rows, labels = [], []
    for k in (rnd.randrange(2) for _ in range(600)):
        text = f'some words token = "{hexes(32)}" more' if k % 2 else "some ordinarywordsinarow and more words"
        a, b = (text.index('"') + 1, text.rindex('"')) if k % 2 else (5, 24)
        rows.append(pii.features(text, a, 4, b))
        labels.append(k % 2)
    model = pii.train(np.array(rows[:400]), np.array(labels[:400]))
    assert ((model.chance(np.array(rows[400:])) >= pii.PRECISION) == np.array(labels[400:], bool)).mean() > 0.99


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_encode_as_the_library(name):
    from worklake.llm.hashing import utf8
    import pyarrow as pa

    e = tokens.Encoder(tokens.vocabulary(name))
    rnd = random.Random(5)
    signs = ["a", "B", "  ", " ", "\n", "\n ", "'s", "don't", "é", "ß", "×", "1", "23", "...", "***", " ", "　", "é", "≠",
             "日本", "🙂", "\t", "_", "İ", "<|endoftext|>", "\x00", "I'm", "'RE", "–", "…"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 30))) for _ in range(1500)]
    raw, at = utf8(pa.array(texts))
    assert e.quick
    for text, ids in zip(texts, e.rows(raw, at), strict=True):
        assert ids.tolist() == e.library.encode(text, add_special_tokens=False).ids, text


def test_packing(docs):
    path = tokens.vocabulary("word_bpe_49k.json")
    library = tokens.Encoder(path).library
    pieces, by_doc, by_sequence = packing.report(docs, path).collect(), defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for r in docs.collect():
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for p in sorted(by_doc[r.doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    filled = 0
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.SIZE
        filled += at
    assert filled > 0.97 * packing.SIZE * len(by_sequence)
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_patterns_hold_every_length():
    rnd = random.Random(4)
    for _ in range(30):
        histogram = {rnd.randint(1, 64): rnd.randint(1, 500) for _ in range(rnd.randint(1, 40))}
        used = Counter()
        for lengths, n in packing.patterns(histogram, 64):
            assert sum(lengths) <= 64
            used.update({k: v * n for k, v in Counter(lengths).items()})
        assert used == histogram


def test_patterns_pack_piece_by_piece():
    """As many packs, as full, as when each piece goes to the least filled pack with room, else into a new one."""
    rnd = random.Random(8)
    odd = [{100: 2000}, {700: 400, 300: 800}, {2048: 3, 1: 5000}, {1025: 50, 1024: 51, 1023: 49}, {37: 9000, 1500: 3, 900: 40}]
    for histogram in odd + [{rnd.randint(1, 2048): rnd.randint(1, 60) for _ in range(rnd.randint(1, 30))} for _ in range(20)]:
        packs = []
        for length in sorted(histogram, reverse=True):
            for _ in range(histogram[length]):
                if packs and packs[0] + length <= 2048:
                    heapq.heapreplace(packs, packs[0] + length)
                else:
                    heapq.heappush(packs, length)
        got = packing.patterns(histogram)
        assert Counter(packs) == Counter([sum(lengths) for lengths, n in got for _ in range(n)]), histogram
    for histogram, least in (({100: 100_000}, 0.97), ({700: 10_000, 300: 20_000}, 0.95), ({300: 50_000} | {k: 20 for k in range(1, 2049)}, 0.97)):
        ids, n = sum(k * v for k, v in histogram.items()), sum(n for _, n in packing.patterns(histogram))
        assert ids >= least * n * packing.SIZE, histogram


def test_hot_length_is_packed_densely(spark):
    rows = [(k, 0, 300 if k % 3 else 700, k, 1) for k in range(3000)]
    pieces = packing.materialize(spark.createDataFrame(rows, packing.PIECES))
    by_sequence = defaultdict(list)
    for p in packing.pack(pieces).collect():
        by_sequence[p.sequence_id].append((p.offset, p.length))
    assert sorted(by_sequence) == list(range(len(by_sequence))) and len(by_sequence) < 700
    for ps in by_sequence.values():
        ends = [0, *(a + n for a, n in sorted(ps))]
        assert [a for a, _ in sorted(ps)] == ends[:-1] and ends[-1] <= packing.SIZE


def test_whole_sequences(docs):
    packed = packing.pack(packing.materialize(packing.cut(docs, tokens.vocabulary("word_bpe_49k.json"), with_ids=True)))
    for r in packing.sequences(packed).collect():
        n = sum(r.lengths)
        assert len(r.ids) == (n if n & (n - 1) == 0 else packing.SIZE)


def test_records(spark, docs, tmp_path):
    path, folder = tokens.vocabulary("byte_bpe_50k.json"), f"file://{tmp_path}/records"
    library = tokens.Encoder(path).library
    ids = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.collect()}
    start, want = 0, {}
    for i in sorted(ids):
        want[i] = (start, len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes()))
        start += len(ids[i])
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in records.report(docs, path).collect()} == want
    index = records.write(docs, path, folder=folder)
    some = records.read_at(index.filter("doc_id in (3, 77, 150)")).collect()
    assert {r.doc_id: r.ids for r in some} == {i: ids[i] for i in (3, 77, 150)}
    file = next((tmp_path / "records").iterdir())
    data = bytearray(file.read_bytes())
    data[len(data) // 2] ^= 1
    file.write_bytes(bytes(data))
    with pytest.raises(Exception, match="Damaged|at \\d+"):
        records.read(spark, index).count()


def test_salvage(spark, tmp_path):
    recs = [warc.record(k, f"http://a/{k}", b"payload %d " % k * 50) for k in range(6)]
    squeezed = [warc.member(r) for r in recs]
    broken = bytearray(squeezed[2])
    broken[len(broken) // 2] ^= 0xFF
    cut = squeezed[4][:-20]
    packed = b"".join([squeezed[0], squeezed[1], bytes(broken), squeezed[3], cut, squeezed[5], b"noise\x1f\x8b\x08 noise"])
    plain = recs[0] + recs[1][:-40] + recs[2] + b"WARC/1.1\r\nbroken\r\n\r\n" + recs[3] + recs[4].replace(b"payload 4", b"PAYLOAD 4", 1) + recs[5]
    for n, (data, left) in enumerate(((packed, [0, 1, 3, 5]), (plain, [0, 2, 3, 5]))):
        folder = tmp_path / str(n)
        folder.mkdir()
        (folder / "a.warc").write_bytes(data)
        rows = warc.read(spark, str(folder)).collect()
        assert [r.page_id for r in rows if r.kind == "record"] == left
        assert all(r.payload == b"payload %d " % r.page_id * 50 for r in rows if r.kind == "record")
        at = 0
        for r in rows:  # records and gaps cover every byte
            assert r.offset == at
            at += r.length
        assert at == len(data) and sum(r.kind == "gap" for r in rows) == 3 and all(r.problem for r in rows if r.kind == "gap")
    import gzip

    assert gzip.decompress(squeezed[0]) == recs[0] and squeezed[0][-1] == 0


def test_salvage_within_members():
    rnd = random.Random(11)
    load = [bytes(rnd.randrange(256) for _ in range(3000)) + b"%d" % k for k in range(60)]
    recs = [warc.record(k, f"http://a/{k}", v) for k, v in enumerate(load)]
    starts = [sum(map(len, recs[:k])) for k in range(61)]

    def pages(data):
        rows = list(warc.salvage(data))
        good = [(at, inner, int(one["warc-record-id"].split(":")[2])) for at, _, inner, one in rows if isinstance(one, dict)]
        return good, [(at, inner, one) for at, _, inner, one in rows if isinstance(one, str)]

    whole = warc.member(b"".join(recs))
    good, gaps = pages(whole)
    assert good == [(0, starts[k], k) for k in range(60)] and not gaps
    bad = [r.replace(load[k][:9], b"different", 1) if k in (3, 30) else r for k, r in enumerate(recs)]
    lone = warc.member(recs[7])
    good, gaps = pages(warc.member(b"".join(bad)) + lone)  # sound gzip, two bad records
    size = len(warc.member(b"".join(bad)))
    assert good == [(0, starts[k], k) for k in range(60) if k not in (3, 30)] + [(size, 0, 7)]
    assert gaps == [(0, starts[3], "block digest"), (0, starts[30], "block digest")]
    cut = whole[: len(whole) * 2 // 3]  # the stream ends early, another member follows or not
    for tail in (b"", lone):
        good, gaps = pages(cut + tail)
        assert [k for at, _, k in good if at == 0] == list(range(len(good) - bool(tail))) and 35 < len(good) < 42
        assert len(gaps) == 1 and gaps[0][0] == 0 and gaps[0][2].startswith("gzip") and (not tail or good[-1] == (len(cut), 0, 7))
    for level in (0, 6):  # a flipped byte; level 0 stores records as they are
        squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
        hit = bytearray(squeeze.compress(b"".join(recs)) + squeeze.flush())
        hit[len(hit) // 2] ^= 0xFF
        good, gaps = pages(bytes(hit) + lone)
        found = [k for at, _, k in good[:-1]]
        assert found[:28] == list(range(28)) and len(set(found)) == len(found) and good[-1] == (len(hit), 0, 7)
        assert any(problem.startswith("gzip") for _, _, problem in gaps)
    hit = bytearray(whole)
    hit[-6] ^= 1  # only the checksum: every record is proven by its digest
    assert [k for _, _, k in pages(bytes(hit))[0]] == list(range(60))
    assert len(pages(bytes(hit))[1]) == 1


def labels_plainly(sets):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def shingles_plainly(text, size=2):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def test_families_of_near_copies(spark):
    rnd = random.Random(9)
    texts = []
    for size, edits in ((60, 0.04), (40, 0.055), (25, 0.07), (30, 0.0)):
        base = [f"b{rnd.randrange(10**6)}" for _ in range(rnd.randint(12, 200))]
        texts += [" ".join(f"e{rnd.randrange(10**6)}" if rnd.random() < edits else w for w in base) for _ in range(size)]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: r.component_id for r in near_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == labels_plainly({i: shingles_plainly(t) for i, t in rows})
    got = {r.doc_id: r.component_id for r in near_dedup.report(spark.createDataFrame(rows, "doc_id long, text string"), size=5).collect()}
    assert got == labels_plainly({i: shingles_plainly(t, 5) for i, t in rows})


def test_components(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(300)] + [(k, k + 1) for k in range(500, 560)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = near_dedup.components(spark.createDataFrame(links, "d long, e long")).collect()
    assert {r.node: r.label for r in got} == {i: root(i) for i in parent}


def test_proximity(spark):
    """Passages with eight of a window's ten words are near, whichever two were changed; far words are not."""
    rnd = random.Random(12)
    items = {k: [f"i{k}w{j}" for j in range(rnd.choice((10, 12, 25)))] + ["the"] * (k % 2) for k in range(12)}
    items[12] = ["a", "b", "a", "b", "c", "c", "d", "d", "e", "e"]  # five different words
    texts, want = [], []
    for k, words in items.items():
        for gone in ([0, 1], [0, 9], [4, 5], [8, 9], [3]) if k < 12 else ([4, 5], [8]):
            passage = [f"typo{len(texts)}x{j}" if j in gone else w for j, w in enumerate(words[:10])]
            passage = passage[::-1] if rnd.random() < 0.3 else passage
            texts.append([f"f{rnd.randrange(99)}" for _ in range(20)] + passage + ["the"] * 20)
            want.append({k})
        texts.append([w for a in words[:10] for w in [a] + ["far"] * 25] if k < 12 else ["a", "b", "c"])
        want.append(set())
    for k in (0, 1):  # makes the rarest word another one, in every way
        texts += [items[k][0:1] * 9, items[k][1:3] * 9, items[k][0:10]]
        want += [set(), set(), {k}]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in items.items()], "item_id long, text string")
    for limit in (decontaminate.BROADCAST_ROWS, 0):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(decontaminate, "BROADCAST_ROWS", limit)
            got = {r.doc_id: r for r in decontaminate.report(docs, bench).collect()}
        met = {i for i, t in enumerate(texts) for w in items.values() if any(t[a : a + 10] == w[b : b + 10] for a in range(len(t) - 9) for b in range(len(w) - 9))}
        assert {i for i, r in got.items() if r.contaminated} == met
        assert [got[i].n_near + got[i].n_items for i in range(len(texts))] == [len(w) for w in want]


def test_pipeline(spark, docs):
    """Documents and their token counts against a plain run of all stages."""
    rows = [r.asDict() for r in docs.collect()]
    verdict = {r.doc_id: r.kept for r in quality.report(docs).collect()}
    rows = [r for r in rows if verdict[r["doc_id"]]]
    label = labels_plainly({r["doc_id"]: shingles_plainly(r["text"], 5) for r in rows})
    rows = [r for r in rows if label[r["doc_id"]] == r["doc_id"]]
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m.group().lower(), t or ""))
    grams = {}
    for b in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = low(b.text)
        for k in range(max(1, len(w) - 9) if w else 0):
            grams[tuple(w[k : k + 10])] = 1
    sizes = {len(g) for g in grams}
    rows = [r for r in rows if not any(tuple(w[k : k + n]) in grams for w in [low(r["text"])] for n in sizes for k in range(len(w) - n + 1))]
    model = pii.fit(spark.createDataFrame(rows, docs.schema))
    library = tokens.Encoder(tokens.vocabulary("word_bpe_49k.json")).library
    want = {}
    for r in rows:
        text = pii.redact(r["text"] or "", pii.spans(r["text"] or "", model)[1])
        want[r["doc_id"]] = len(library.encode(text, add_special_tokens=False).ids) + 1
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert {p.doc_id: p.doc_tokens for p in got} == want
    assert len(want) > 100

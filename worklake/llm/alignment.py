"""Alignment of two tokenizers over a corpus, with an identity map as the fast path.

Tokens of A (byte-level, tokenizers library) and of B (sentencepiece, byte fallback) cover the same
bytes, a space and the text. Byte offsets where tokens of both end cut them into groups; the tokens that
end there are linked. An array over A's vocabulary names the B id of the same bytes. A group of one
token each that the array foretells is exact: its links are counted in a vector as long as the
vocabulary. Only links of other groups become rows of pairs and are shuffled.

Texts are cut where A starts a piece of its own and where no piece of B holds the bytes on either side
next to each other, so that neither tokenizer looks across; each worker aligns such a segment once (a
table bounded by bytes, found by two 64-bit hashes). Texts with white space beyond ASCII are one segment.

Texts are encoded once; what they give is written and read again for counting and for the sums. A
document's numbers do not depend on how its rows are dealt. Null or empty text, and text that tokens of
A or B do not spell (one that holds U+2581, for instance), has no tokens: zeros and ''. Repeated rows
and ids are rows of their own, ties count as best, very long texts pass in parts, an empty table gives
an empty one, and other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklake.llm import tokens
from worklake.llm.hashing import BLOCK, row_blocks, spans_hash, utf8
from worklake.llm.tables import materialize

#: Bytes of a worker's table of segments; beyond, it starts anew.
TABLE_BYTES = 64 << 20
#: Pairs that a task counts before it passes them on.
FLUSH = 1 << 20
SPACE_SIGN = "▁"


class Ragged:
    """Rows of different lengths, one after the other."""

    def __init__(self, kind):
        self.data, self.begin, self.n = np.zeros(1 << 12, kind), np.zeros(1 << 12, np.int64), 0

    def add(self, sizes: np.ndarray, flat: np.ndarray) -> None:
        a, b = self.n, self.n + len(sizes)
        if b + 1 > len(self.begin):
            self.begin = np.r_[self.begin, np.zeros((1 << b.bit_length()) + 1 - len(self.begin), np.int64)]
        self.begin[a + 1 : b + 1] = self.begin[a] + np.cumsum(sizes)
        first, last = int(self.begin[a]), int(self.begin[b])
        if last > len(self.data):
            self.data = np.r_[self.data, np.zeros((1 << last.bit_length()) - len(self.data), self.data.dtype)]
        self.data[first:last] = flat
        self.n = b

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows' values and where each row's begin."""
        begin, size = self.begin[rows], self.begin[rows + 1] - self.begin[rows]
        total = np.r_[0, np.cumsum(size)]
        return self.data[np.repeat(begin - total[:-1], size) + np.arange(int(total[-1]))], total


class Segments(tokens.Encoder):
    """Segments of texts, each aligned once. The table of hashes is that of the encoder."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        super().__init__(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = {c: bytes([k]) for k, c in enumerate(self.signs)}
        vocabulary = dict(sorted((i, t) for t, i in self.library.get_vocab(with_added_tokens=True).items()))
        a_bytes = [b"".join(byte.get(c, c.encode()) for c in vocabulary.get(i, "")) for i in range(max(vocabulary) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        alone = [self.b.is_byte(i) for i in range(len(pieces))]
        b_bytes = [bytes([int(p[3:5], 16)]) if one else p.replace(SPACE_SIGN, " ").encode() for p, one in zip(pieces, alone, strict=True)]
        self.joins = joins(x for x, one in zip(b_bytes, alone, strict=True) if not one)
        self.lead = self.b.encode("\n")
        self.whole = bool(self.joins[0x0A].any() or self.joins[:, 0x0A].any())
        self.joins |= self.whole  # nothing is cut within a text
        self.a_spelt, self.b_spelt = Spelling(a_bytes), Spelling(b_bytes)
        self.same = identity_map(a_bytes, b_bytes, alone)
        self.narrow = max(len(a_bytes), len(b_bytes)) <= 1 << 16
        self.digits = Spelling([str(i).encode() for i in range(max(len(a_bytes), len(b_bytes)))])

    def _clear(self) -> None:
        super()._clear()
        self.texts: list[bytes] = []
        self.counts, self.exact, self.odd, self.held = Ragged(np.int32), Ragged(np.uint32), Ragged(np.uint64), 0

    def _encode_b(self, pieces: list[bytes]) -> list[list[int]]:
        if self.whole:  # texts begin with the space that B adds
            return self.b.encode([p[1:].decode() for p in pieces])
        skip = len(self.lead)  # of the added space and a line end that no piece joins with
        return [x[skip:] for x in self.b.encode(["\n" + p.decode() for p in pieces], num_threads=1)]

    def align(self, raw: np.ndarray, at: np.ndarray) -> None:
        """Files the segments whose bytes begin at `at` as new entries."""
        whole = raw.tobytes()
        pieces = [whole[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        a_ids, a_at = _flat(self._learn(pieces))
        b_ids, b_at = _flat(self._encode_b(pieces))
        good = self.a_spelt.spells(a_ids, a_at, raw, at) & self.b_spelt.spells(b_ids, b_at, raw, at)
        if not good.all():
            a_ids, a_at = _only(a_ids, a_at, good)
            b_ids, b_at = _only(b_ids, b_at, good)
        a_end, b_end = np.cumsum(self.a_spelt.sizes[a_ids]), np.cumsum(self.b_spelt.sizes[b_ids])
        ends = np.intersect1d(a_end, b_end, assume_unique=True)
        i, j = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
        segment = np.searchsorted(a_at, i, "right") - 1
        n_a, n_b = np.diff(np.r_[-1, i]), np.diff(np.r_[-1, j])
        alone = (n_a == 1) & (n_b == 1) & (self.same[a_ids[i]] == b_ids[j])
        n = len(pieces)
        counts = np.stack([np.diff(a_at), np.diff(b_at), np.bincount(segment, minlength=n), ~good], 1)
        self.counts.add(np.full(n, 4), counts.ravel())
        self.exact.add(np.bincount(segment[alone], minlength=n), a_ids[i[alone]])
        pairs = (a_ids[i[~alone]].astype(np.uint64) << np.uint64(32)) | b_ids[j[~alone]].astype(np.uint64)
        self.odd.add(np.bincount(segment[~alone], minlength=n), pairs)
        texts = self._written(a_ids, b_ids, i, j, n_a, n_b, np.searchsorted(segment, np.arange(n + 1)))
        self.texts += texts
        self.held += len(whole) + sum(map(len, texts)) + 150 * n + 8 * len(i)

    def _written(self, a_ids, b_ids, i, j, n_a, n_b, cut) -> list[bytes]:
        """`a1,a2|b1;a3|b2` of each segment: every id is followed by the sign between it and the next."""
        total = len(a_ids) + len(b_ids)
        ids, sign = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
        before = np.r_[0, np.cumsum(n_a + n_b)]  # ids before each group; its ids of A come first
        a_place = np.repeat(before[:-1] - np.r_[0, np.cumsum(n_a)][:-1], n_a) + np.arange(len(a_ids))
        b_place = np.repeat(before[:-1] + n_a - np.r_[0, np.cumsum(n_b)][:-1], n_b) + np.arange(len(b_ids))
        ids[a_place], ids[b_place] = a_ids, b_ids
        sign[a_place[i]], sign[b_place[j]] = ord("|"), ord(";")
        raw, at = self.digits.written(ids, sign)
        text, at = raw.tobytes(), np.r_[at, len(raw)][before[cut]].tolist()
        return [text[x : max(x, y - 1)] for x, y in zip(at, at[1:], strict=False)]

    def entries(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry of each segment of a block of rows, and where each row's begin."""
        if self.held > TABLE_BYTES:
            self._clear()
        starts = self._starts(raw, at)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
        ends = np.r_[starts[1:], len(raw)]
        h1 = spans_hash(raw, starts, ends, 0) | np.uint64(1)
        h2 = spans_hash(raw, starts, ends, 1)
        e = self._find(h1)
        new = np.flatnonzero(e < 0)
        if len(new):
            keys, which, back = np.unique(h1[new], return_index=True, return_inverse=True)
            one = new[which]
            e[new] = self._add(keys, h2[one], [()] * len(one))[back]
            self.align(*_gather(raw, starts[one], ends[one]))
        odd = np.flatnonzero(self.second[e] != h2)
        if len(odd):  # two segments with one hash: the later one is aligned for itself, not filed
            first = len(self.texts)
            self.align(*_gather(raw, starts[odd], ends[odd]))
            e[odd] = np.arange(first, first + len(odd))
            self.held = TABLE_BYTES + 1  # its entries are not those of the table any more
        return e, np.searchsorted(starts, at)

    def _starts(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where segments start: at rows, and where A begins a piece that B joins with nothing before it."""
        starts = tokens._cuts(raw, at)
        row = np.isin(starts, at)
        return starts[row | ~self.joins[raw[starts - 1], raw[starts]]]

    def rows(self, raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, bytes, bytes, bytes]]:
        """For each row: counts (tokens of A, of B, groups), digest, ids of exact groups, other pairs."""
        for first, last in row_blocks(at):
            a, b = int(at[first]), int(at[last])
            long = b - a > 4 * BLOCK
            sums, digest = np.zeros((last - first, 4), np.int64), hashlib.sha256()
            exact, odd = [[] for _ in sums], [[] for _ in sums]
            for k, part in enumerate(tokens._parts(raw[a:b]) if long else [raw[a:b]]):
                e, begin = self.entries(part, np.array([0, len(part)]) if long else at[first : last + 1] - a)
                total = np.r_[np.zeros((1, 4), np.int64), np.cumsum(self.counts.take(e)[0].reshape(-1, 4), 0, dtype=np.int64)]
                sums += total[begin[1:]] - total[begin[:-1]]
                (x, x_at), (y, y_at) = self.exact.take(e), self.odd.take(e)
                for i in range(len(sums)):
                    u, v = int(begin[i]), int(begin[i + 1])
                    exact[i].append(x[x_at[u] : x_at[v]])
                    odd[i].append(y[y_at[u] : y_at[v]])
                    text = b";".join([self.texts[s] for s in e[u:v].tolist()])
                    if not long:
                        digest = hashlib.sha256(text)
                        yield self._row(sums[i], digest, exact[i], odd[i])
                    else:
                        digest.update(b";" + text if k else text)
            if long:
                yield self._row(sums[0], digest, exact[0], odd[0])

    def _row(self, sums, digest, exact, odd):
        if sums[3] or not sums[0]:
            return np.zeros(3, np.int64), "", b"", b""
        return sums[:3], digest.hexdigest(), *self._packed(np.concatenate(exact), np.concatenate(odd))


    def _packed(self, exact: np.ndarray, odd: np.ndarray) -> tuple[bytes, bytes]:
        if not self.narrow:
            return exact.astype("<u4").tobytes(), odd.astype("<u8").tobytes()
        return exact.astype("<u2").tobytes(), ((odd >> np.uint64(16)) | (odd & np.uint64(0xFFFF))).astype("<u4").tobytes()


class Spelling:
    """The bytes of each id."""

    def __init__(self, spelt: list[bytes]):
        self.sizes = np.array([len(x) for x in spelt], np.int64)
        self.at = np.r_[0, np.cumsum(self.sizes)]
        self.raw = np.frombuffer(b"".join(spelt), np.uint8)

    def spells(self, ids: np.ndarray, ids_at: np.ndarray, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the ids of each row spell its bytes."""
        total = np.r_[0, np.cumsum(self.sizes[ids])][ids_at]
        out = np.diff(total) == np.diff(at)
        mine, its = (ids, raw) if out.all() else (ids[np.repeat(out, np.diff(ids_at))], raw[np.repeat(out, np.diff(at))])
        spelt, _ = _gather(self.raw, self.at[mine], self.at[mine + 1])
        wrong = np.flatnonzero(spelt != its)
        if len(wrong):
            rows = np.flatnonzero(out)
            ends = np.cumsum(np.diff(at)[rows])
            out[rows[np.searchsorted(ends, wrong, "right")]] = False
        return out

    def written(self, ids: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids, a sign after each, and where each begins."""
        size = self.sizes[ids] + 1
        at = np.r_[0, np.cumsum(size)]
        out = np.empty(int(at[-1]), np.uint8)
        last = at[1:] - 1
        inner = np.ones(len(out), bool)
        inner[last] = False
        out[inner] = _gather(self.raw, self.at[ids], self.at[ids + 1])[0]
        out[last] = sign
        return out, at[:-1]


def joins(pieces: Iterable[bytes]) -> np.ndarray:
    """Which byte stands before which inside some piece; texts may be cut between all others."""
    out = np.zeros((256, 256), bool)
    out[0x80:, 0x80:0xC0] = True  # within a character
    for piece in pieces:
        x = np.frombuffer(piece, np.uint8)
        out[x[:-1], x[1:]] = True
    return out


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    at = np.zeros(len(lists) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)), out=at[1:])
    return np.fromiter(chain.from_iterable(lists), np.int64, int(at[-1])), at


def identity_map(a_bytes: list[bytes], b_bytes: list[bytes], b_is_byte: list[bool]) -> np.ndarray:
    """B id of the same bytes for each A id, -1 where there is none; a piece comes before a lone byte."""
    ids = {x: i for i, x in enumerate(b_bytes) if b_is_byte[i]}
    ids.update({x: i for i, x in enumerate(b_bytes) if not b_is_byte[i]})
    return np.array([ids.get(x, -1) if x else -1 for x in a_bytes], np.int64)


def _only(ids: np.ndarray, at: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(at)
    return ids[np.repeat(good, sizes)], np.r_[0, np.cumsum(np.where(good, sizes, 0))]


def _gather(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.r_[0, np.cumsum(ends - starts)]
    return raw[np.repeat(starts - at[:-1], ends - starts) + np.arange(int(at[-1]))], at


_SEGMENTS: dict[tuple[str, str], Segments] = {}


def segments(a_path: str, b_path: str) -> Segments:
    if (a_path, b_path) not in _SEGMENTS:
        _SEGMENTS[a_path, b_path] = Segments(a_path, b_path)
    return _SEGMENTS[a_path, b_path]


def aligned(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (r, doc_id, n_a, n_b, n_groups, groups_sha256, exact, odd); the last two are packed ids and pairs."""

    def encode(batches):
        table = segments(a_path, b_path)
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                column = part.column("text")
                spaced = pc.binary_join_element_wise("", column.fill_null(""), " ")
                spaced = pc.if_else(pc.equal(pc.binary_length(spaced), 1), "", spaced)
                out = list(table.rows(*utf8(spaced)))
                numbers = np.array([x[0] for x in out], np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays(
                    [part.column("r"), part.column("doc_id"), *[pa.array(numbers[:, c]) for c in range(3)],
                     *[pa.array([x[c] for x in out], t) for c, t in ((1, pa.string()), (2, pa.binary()), (3, pa.binary()))]],
                    ["r", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "exact", "odd"],
                )

    rows = docs.select(
        F.monotonically_increasing_id().alias("r"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"r long, doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, exact binary, odd binary"
    return rows.mapInArrow(encode, schema)


def _unpacked(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers packed in a binary column, and where each row's begin."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    size = np.dtype(kind).itemsize
    return raw[offsets[0] : offsets[-1]].copy().view(kind), (offsets - offsets[0]) // size


def ids_of(column: pa.Array, narrow: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of exact groups, and where each row's begin."""
    return _unpacked(column, "<u2" if narrow else "<u4")


def pairs_of(column: pa.Array, narrow: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs as a * 2^32 + b, and where each row's begin."""
    pairs, at = _unpacked(column, "<u4" if narrow else "<u8")
    if narrow:
        pairs = (pairs.astype(np.uint64) >> np.uint64(16) << np.uint64(32)) | (pairs & np.uint32(0xFFFF)).astype(np.uint64)
    return pairs, at


def exact_counts(parts: DataFrame, size: int, narrow: bool) -> np.ndarray:
    """How many exact groups each A id has: a vector as long as the vocabulary."""

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(ids_of(batch.column(0), narrow)[0], minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["a", "n"])

    out = np.zeros(size, np.int64)
    for row in parts.select("exact").mapInArrow(count, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).collect():
        out[row.a] = row.n
    return out


def pair_counts(parts: DataFrame, narrow: bool) -> DataFrame:
    """Pairs (pair = a * 2^32 + b, n) of links outside exact groups, over all rows."""

    def count(batches):
        held, size = [], 0
        for batch in batches:
            held.append(pairs_of(batch.column(0), narrow)[0])
            size += len(held[-1])
            if size > FLUSH:
                yield _counted(held)
                held, size = [], 0
        if size:
            yield _counted(held)

    def _counted(held):
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["pair", "n"])

    return parts.select("odd").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def counted(parts: DataFrame, a_path: str, b_path: str) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Counts of exact pairs by A id, whether they are their B id's highest, and the other pairs (pair, n, best)."""
    spark, table = parts.sparkSession, segments(a_path, b_path)
    exact = exact_counts(parts, len(table.same), table.narrow)
    others = materialize(pair_counts(parts, table.narrow), "pairs")
    b = F.col("pair").bitwiseAND((1 << 32) - 1)
    highest = np.zeros(len(table.b_spelt.sizes), np.int64)
    for row in others.groupBy(b.alias("b")).agg(F.max("n").alias("n")).collect():  # a row for each B id at most
        highest[row.b] = row.n
    known = np.flatnonzero((table.same >= 0) & (exact > 0))
    np.maximum.at(highest, table.same[known], exact[known])
    best = np.zeros(len(exact), bool)
    best[known] = exact[known] == highest[table.same[known]]
    top = spark.createDataFrame(pa.table({"b": np.arange(len(highest)), "top": highest}))
    others = others.withColumn("b", b).join(F.broadcast(top), "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    return exact, best, others


def report(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row a document: tokens, groups, links, links that are the best of their B id, sum of the links' counts."""
    parts = materialize(aligned(docs, a_path, b_path), "aligned")
    exact, best, others = counted(parts, a_path, b_path)
    narrow = segments(a_path, b_path).narrow
    sent = parts.sparkSession.sparkContext.broadcast((exact, best))

    def add_exact(batches):
        exact, best = sent.value
        for batch in batches:
            ids, at = ids_of(batch.column(batch.schema.get_field_index("exact")), narrow)
            sums = [np.diff(np.r_[0, np.cumsum(v[ids], dtype=np.int64)][at]) for v in (exact, best)]
            plain = batch.drop_columns(["exact"])
            yield pa.RecordBatch.from_arrays([*plain.columns, *map(pa.array, sums)], [*plain.schema.names, "e_sum", "e_best"])

    def links(batches):
        for batch in batches:
            pairs, at = pairs_of(batch.column(1), narrow)
            rows = np.repeat(np.arange(batch.num_rows), np.diff(at))
            order = np.lexsort((pairs, rows))
            pairs, rows = pairs[order], rows[order]
            first = np.flatnonzero(np.r_[True, (pairs[1:] != pairs[:-1]) | (rows[1:] != rows[:-1])][: len(pairs)])
            times = np.diff(np.r_[first, len(pairs)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows[first])), pa.array(pairs[first].view(np.int64)), pa.array(times)],
                ["r", "pair", "m"],
            )

    plain = parts.drop("odd")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema if f.name != "exact")
    rows = plain.mapInArrow(add_exact, f"{kept}, e_sum long, e_best long")
    odd = (
        parts.select("r", "odd").mapInArrow(links, "r long, pair long, m long").join(others, "pair")
        .groupBy("r").agg(F.sum(F.col("m") * F.col("n")).alias("o_sum"), F.sum(F.when(F.col("best"), F.col("m"))).alias("o_best"))
    )
    plus = lambda x, y: F.col(x) + F.coalesce(F.col(y), F.lit(0).cast("long"))
    return rows.join(odd, "r", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), plus("e_best", "o_best").alias("n_best"),
        plus("e_sum", "o_sum").alias("count_sum"), "groups_sha256",
    )

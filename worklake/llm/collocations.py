"""Collocations by the stripes pattern: each prefix keys an associative counter of its next words.

Texts are lower-cased (A-Z), cut at punctuation and line ends into pieces, and those into words; all is
per language (null: `und`). A stripe is one row: a prefix of 0 to 3 words and arrays of next words and
their counts. Tasks make a stripe for each prefix in their rows, equal prefixes meet and are merged
element by element. The merged stripes hold all that is asked for: an element is the count of an
extension and so the total of the prefix one word longer; the largest element an extension has, at the
prefix and at the same words without the first, decides whether a longer phrase subsumes it.

Counts below the threshold can't be part of a candidate, so a level is sought only among phrases whose
parts were frequent before. Tasks are told which were by a bitmap of bounded size (MAX_BITS): a bit set by chance lets
a phrase be counted for nothing and changes no result. A prefix that makes up 1/HOT of all words (there
can be no more than HOT of them) has its stripe split by next word, so that no task merges a whole one.

A word is a 64-bit hash of language and word; a second hash proves over the whole corpus that no two
words share one (else other hashes are taken). Prefixes are kept as the hashes of their words, so
counts are exact. Scores are worked out in 38-digit decimals.

Null and empty texts and an empty table have no words. Repeated rows and ids count each. Ties go by
count, then phrase in UTF-8 order. Very long texts pass in blocks. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklake.llm.hashing import LOWER, mix, row_blocks, spans_hash, utf8, word_spans
from worklake.llm.tables import materialize

LEAST, LONGEST, TOP = 30, 4, 2000
SCALE, SHARE = 2_000_000, 80  # score's factor; per cent of a count that subsumes
UNKNOWN = "und"
MAX_BITS, LEAST_BITS, BITS_EACH = 1 << 27, 1 << 20, 16
HOT, PARTS = 1000, 64
#: Words or phrases that a task counts at once, and words whose text a task has passed on already.
FLUSH = 1 << 21

_BREAK = np.isin(np.arange(256), [*b".,;:!?", *range(0x0A, 0x0E)])
_APART = _BREAK | np.isin(np.arange(256), [0x20, 0x09])


class Words:
    """Words of a block of rows: language hash mixed into each word's hash, and the piece it stands in."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, langs: np.ndarray, seed: int):
        self.raw = LOWER[raw]
        self.starts, self.ends, rows = word_spans(self.raw, at, _APART)
        self.row = np.repeat(np.arange(len(at) - 1), np.diff(rows))
        self.piece = np.cumsum(_BREAK[self.raw], dtype=np.int32)[self.starts] if len(self.starts) else np.zeros(0, np.int32)
        self.salt = langs[self.row]
        self.id = mix(spans_hash(self.raw, self.starts, self.ends, 0) ^ self.salt)
        if seed:
            self.id = mix(self.id + self.check() * np.uint64(2 * seed + 1))

    def check(self) -> np.ndarray:
        return mix(spans_hash(self.raw, self.starts, self.ends, 1) + self.salt)

    def runs(self, size: int) -> np.ndarray:
        """Whether `size` words from each word on stand in one piece of one row."""
        n = max(0, len(self.id) - size + 1)
        last = size - 1
        return (self.piece[:n] == self.piece[last : last + n]) & (self.row[:n] == self.row[last : last + n])


def _blocks(batch: pa.RecordBatch, seed: int) -> Iterator[tuple[pa.Array, Words]]:
    """The languages and the words of blocks of rows."""
    text, lang = batch.column(0), batch.column(1)
    raw, at = utf8(text)
    l_raw, l_at = utf8(lang)
    langs = spans_hash(l_raw, l_at[:-1], l_at[1:], 1)
    for first, last in row_blocks(at):
        a, b = int(at[first]), int(at[last])
        yield lang.slice(first, last - first), Words(raw[a:b], at[first : last + 1] - a, langs[first:last], seed)


def _grouped(keys: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Different rows of the key columns in order, and how often (or with which sum) each occurs."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    if not len(order):
        return keys, np.zeros(0, np.int64)
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    n = np.diff(np.r_[first, len(order)]) if counts is None else np.add.reduceat(counts[order], first)
    return [k[first] for k in keys], n.astype(np.int64)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(
        F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang")
    ).filter("text is not null")


def words(texts: DataFrame, seed: int) -> DataFrame:
    """The stripe of the empty prefix: (lang, w, second hash c, f) of each word of each language, counted per task."""

    def count(batches):
        held: dict[str, list] = {}
        size = 0
        for batch in batches:
            for langs, block in _blocks(batch, seed):
                check = block.check()
                names = langs.dictionary_encode()
                code = names.indices.to_numpy()[block.row] if len(block.id) else np.zeros(0, np.int32)
                for k, name in enumerate(names.dictionary.to_pylist()):
                    mine = code == k
                    held.setdefault(name, []).append((block.id[mine], check[mine]))
                size += len(block.id)
                if size > FLUSH:
                    yield from _rows(held)
                    held, size = {}, 0
        yield from _rows(held)

    def _rows(held):
        for name, parts in held.items():
            (w, c), n = _grouped([np.concatenate(x) for x in zip(*parts, strict=True)])
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(w), pa.string()), _long(w), _long(c), pa.array(n)], ["lang", "w", "c", "f"]
            )

    return texts.mapInArrow(count, "lang string, w long, c long, f long").groupBy("lang", "w", "c").agg(F.sum("f").alias("f"))


def bitmap(keys: DataFrame, key: str = "key") -> np.ndarray:
    """Bits at the low bits of each long key, packed in 64-bit words: at most MAX_BITS bits, so the driver may hold it."""
    bits = LEAST_BITS
    while bits < min(MAX_BITS, BITS_EACH * keys.count()):
        bits *= 2
    at = F.col(key).bitwiseAND(bits - 1)
    rows = keys.select(F.shiftright(at, 15).alias("b"), (at % (1 << 15)).alias("i")).groupBy("b").agg(F.bitmap_construct_agg("i").alias("m"))
    out = np.zeros(bits // 8, np.uint8)
    for row in rows.collect():
        part = np.frombuffer(row.m, np.uint8)
        out[row.b * 4096 : row.b * 4096 + len(part)] = part
    return out


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where two words in a row stand in the bitmap."""
    with np.errstate(over="ignore"):
        return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def _stripes(keys: list[np.ndarray], n: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
    """Stripes of counted phrases in order: prefix p, part of the stripe, next words and their counts."""
    prefix, last = keys[:-1], keys[-1]
    part = np.zeros(len(n), np.int64)
    if len(hot) and len(n):
        split = np.isin(_prefix_key(prefix), hot)
        part[split] = (last[split] % np.uint64(PARTS)).astype(np.int64)
        order = np.lexsort([part, *prefix[::-1]])
        prefix, last, n, part = [p[order] for p in prefix], last[order], n[order], part[order]
    new = np.ones(len(n), bool)
    if len(n):
        new[1:] = part[1:] != part[:-1]
        for p in prefix:
            new[1:] |= p[1:] != p[:-1]
    first = np.flatnonzero(new)
    at = pa.array(np.r_[first, len(n)].astype(np.int32))
    width = len(prefix)
    flat = np.stack([p[first] for p in prefix], 1).ravel()
    return pa.RecordBatch.from_arrays(
        [pa.ListArray.from_arrays(pa.array(np.arange(0, width * len(first) + 1, width, dtype=np.int32)), _long(flat)),
         pa.array(part[first]), pa.ListArray.from_arrays(at, _long(last)), pa.ListArray.from_arrays(at, pa.array(n))],
        ["p", "part", "next", "n"],
    )


def _prefix_key(prefix: list[np.ndarray]) -> np.ndarray:
    key = np.zeros(len(prefix[0]), np.uint64)
    for p in prefix:
        key = _pair_key(key, p)
    return key


_STRIPE = "p array<long>, part long, next array<long>, n array<long>"


def stripes(texts: DataFrame, seed: int, sizes: tuple[int, ...], wanted: Callable, hot: np.ndarray) -> DataFrame:
    """Stripes of each task for phrases of `sizes` words; `wanted(words, size)` says which starts count."""

    def count(batches):
        held: dict[int, list] = {k: [] for k in sizes}
        size = 0
        for batch in batches:
            for _, block in _blocks(batch, seed):
                for k in sizes:
                    at = np.flatnonzero(wanted(block, k))
                    held[k].append([block.id[at + i] for i in range(k)])
                    size += len(at)
                if size > FLUSH:
                    yield from _rows(held)
                    held, size = {k: [] for k in sizes}, 0
        yield from _rows(held)

    def _rows(held):
        for parts in held.values():
            if parts:
                keys, n = _grouped([np.concatenate(x) for x in zip(*parts, strict=True)])
                yield from _slices(_stripes(keys, n, hot))

    return texts.mapInArrow(count, _STRIPE)


def _slices(batch: pa.RecordBatch, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def merged(parts: DataFrame, least: int) -> DataFrame:
    """Stripes of equal prefix (and part) added element by element: rows (g, f, key) of phrases with f >= least.

    `key` is the place of a phrase of two words in the bitmap.
    """

    def merge(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column(2).flatten())
            if size > FLUSH // 2:
                held, size = yield from _merge(held, False)
        yield from _merge(held, True)

    def _merge(held, end):
        """Adds up what is complete; the last prefix may go on in the next batch."""
        rows = pa.Table.from_batches(held).combine_chunks() if held else None
        if rows is None or not rows.num_rows:
            return [], 0
        p, next_, n = (rows.column(k).chunk(0) for k in ("p", "next", "n"))
        at = np.asarray(p.offsets)
        lengths = np.diff(at)
        size = np.diff(np.asarray(next_.offsets))
        row = np.repeat(np.arange(len(size)), size)
        values = np.asarray(p.flatten()).view(np.uint64)
        base = at[:-1] - at[0]
        keys = [np.where(lengths > k, values[np.minimum(base + k, len(values) - 1)], 0) for k in range(lengths.max())]
        part = np.asarray(rows.column("part").chunk(0))
        tail = np.ones(len(size), bool)
        for k in [*keys, part, lengths]:
            tail &= k == k[-1]
        if not end:
            if tail.all():  # one prefix: added up, and carried on
                done = _added(rows, next_, n)
                return [done], len(done.column(2).flatten())
            rest = int(np.flatnonzero(~tail)[-1]) + 1
        else:
            rest = len(size)
        use = row < rest
        flat_next, flat_n = np.asarray(next_.flatten()).view(np.uint64)[use], np.asarray(n.flatten())[use]
        row = row[use]
        (*k, length, last), total = _grouped([*[x[row] for x in keys], lengths[row].astype(np.uint64), flat_next], flat_n)
        enough = np.flatnonzero(total >= least)
        k, length, last, total = [x[enough] for x in k], length[enough].astype(np.int64), last[enough], total[enough]
        flat, at = _phrases(k, length, last)
        if len(total):
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), _long(flat)), pa.array(total), _long(_pair_key(k[0], last))],
                ["g", "f", "key"],
            )
        return rows.slice(rest).to_batches(), int(size[rest:].sum())

    def _added(rows, next_, n):
        (last,), total = _grouped([np.asarray(next_.flatten()).view(np.uint64)], np.asarray(n.flatten()))
        at = pa.array(np.array([0, len(last)], np.int32))
        return pa.RecordBatch.from_arrays(
            [rows.column("p").chunk(0).slice(0, 1), rows.column("part").chunk(0).slice(0, 1),
             pa.ListArray.from_arrays(at, _long(last)), pa.ListArray.from_arrays(at, pa.array(total))],
            ["p", "part", "next", "n"],
        )

    dealt = parts.repartition("p", "part").sortWithinPartitions("p", "part")
    return dealt.mapInArrow(merge, "g array<long>, f long, key long")


def _phrases(prefix: list[np.ndarray], length: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefixes of `length` words and their next word, one after the other."""
    at = np.r_[0, np.cumsum(length + 1)]
    flat = np.zeros(int(at[-1]), np.uint64)
    for k, values in enumerate(prefix):
        has = length > k
        flat[at[:-1][has] + k] = values[has]
    flat[at[1:] - 1] = last
    return flat, at


def spellings(texts: DataFrame, seed: int, frequent) -> DataFrame:
    """(w, word) of words whose bit is set; a task names each once between flushes."""

    def spell(batches):
        bits, told = frequent.value, np.zeros(0, np.uint64)
        for batch in batches:
            for _, block in _blocks(batch, seed):
                new = np.flatnonzero(_has(bits, block.id))
                if len(told):
                    at = np.minimum(np.searchsorted(told, block.id[new]), len(told) - 1)
                    new = new[told[at] != block.id[new]]
                w, first = np.unique(block.id[new], return_index=True)
                first = new[first]
                told = np.sort(np.r_[told, w]) if len(told) < FLUSH else w
                s, e = block.starts[first], block.ends[first]
                spelt = [block.raw[x:y].tobytes().decode() for x, y in zip(s.tolist(), e.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([_long(w), pa.array(spelt, pa.string())], ["w", "word"])

    return texts.mapInArrow(spell, "w long, word string").groupBy("w").agg(F.first("word").alias("word"))


def hot_prefixes(phrases: DataFrame, total: int, size: int) -> np.ndarray:
    """Keys of phrases of `size` words that make up 1/HOT of all words, so at most HOT of them."""
    rows = phrases.filter((F.size("g") == size) & (F.col("f") * HOT >= total)).select("g").collect()
    if not rows:
        return np.zeros(0, np.uint64)
    words = np.array([r.g for r in rows], np.int64).view(np.uint64)
    return _prefix_key([words[:, k] for k in range(size)])


def frequent_phrases(docs: DataFrame, least: int = LEAST, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases (g, f) of 1 to LONGEST words with f >= least; words (w, lang, word); languages (lang, n)."""
    texts = _texts(docs, text, lang)
    spark = docs.sparkSession
    for seed in range(100):
        counted = materialize(words(texts, seed), "words")
        twice = counted.groupBy("w").agg(F.count("*").alias("n")).filter("n > 1")
        if twice.limit(1).isEmpty():
            break
    langs = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    total = counted.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    one = counted.filter(F.col("f") >= least)
    frequent = spark.sparkContext.broadcast(bitmap(one, "w"))
    singles = one.select(F.array("w").alias("g"), "f")

    def both_frequent(block, size):
        ok = _has(frequent.value, block.id)
        n = max(0, len(ok) - 1)
        return block.runs(2) & ok[:n] & ok[1:]

    pairs = materialize(merged(stripes(texts, seed, (2,), both_frequent, hot_prefixes(singles, total, 1)), least), "pairs")
    linked = spark.sparkContext.broadcast(bitmap(pairs))

    def all_linked(block, size):
        ids = block.id
        ok = _has(linked.value, _pair_key(ids[:-1], ids[1:])) if len(ids) else np.zeros(0, bool)
        n = max(0, len(ids) - size + 1)
        out = block.runs(size)
        for k in range(size - 1):
            out &= ok[k : k + n]
        return out

    longer = tuple(range(3, LONGEST + 1))
    more = merged(stripes(texts, seed, longer, all_linked, hot_prefixes(pairs, total, 2)), least)
    phrases = materialize(singles.unionByName(pairs.drop("key")).unionByName(more.drop("key")), "phrases")
    known = one.select("w", "lang").join(spellings(texts, seed, frequent), "w")
    return phrases, known, langs


def _decimal(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def scored(phrases: DataFrame) -> DataFrame:
    """Candidates (g, a, l, r, score) that no longer candidate subsumes, by their lowest-scoring cut."""
    longer = phrases.filter(F.size("g") > 2).select(
        F.explode(F.array(F.expr("slice(g, 1, size(g) - 1)"), F.expr("slice(g, 2, size(g) - 1)"))).alias("g"), "f"
    )
    most = longer.groupBy("g").agg(F.max("f").alias("most"))
    left = phrases.filter(F.size("g") > 1).join(most, "g", "left")
    free = left.filter(F.col("most").isNull() | (_decimal("most") * 100 < _decimal("f") * SHARE)).select("g", F.col("f").alias("a"))
    cuts = free.select("g", "a", F.explode(F.expr("sequence(1, size(g) - 1)")).alias("k"))
    part = lambda name: phrases.select(F.col("g").alias(f"g{name}"), F.col("f").alias(name))
    cuts = (
        cuts.withColumn("gl", F.expr("slice(g, 1, k)")).withColumn("gr", F.expr("slice(g, k + 1, size(g) - k)"))
        .join(part("l"), "gl").join(part("r"), "gr")
    )
    score = F.expr(f"cast({SCALE} as decimal(38,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(38,0)) + cast(r as decimal(38,0)))")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m")
    return cuts.groupBy("g", "a").agg(lowest).select("g", "a", "m.l", "m.r", "m.score")


def report(docs: DataFrame, top: int = TOP, least: int = LEAST, text: str = "text", lang: str = "lang") -> DataFrame:
    """Each language's first `top` collocations: lang, rank, phrase, a, l, r, n, score."""
    phrases, known, langs = frequent_phrases(docs, least, text, lang)
    known = materialize(known, "spelt")
    found = scored(phrases).withColumn("w", F.get("g", 0)).join(known.select("w", "lang"), "w").drop("w")
    by_lang = Window.partitionBy("lang")
    # All that ties with the last one stays until the phrases are known.
    first = found.withColumn("at", F.rank().over(by_lang.orderBy(F.desc("score"), F.desc("a")))).filter(F.col("at") <= top)
    first = materialize(first.drop("at"), "first")
    spelt = (
        first.select("g", F.posexplode("g").alias("i", "w")).join(known.select("w", "word"), "w")
        .groupBy("g").agg(F.sort_array(F.collect_list(F.struct("i", "word"))).alias("ws"))
        .select("g", F.array_join(F.col("ws.word"), " ").alias("phrase"))
    )
    ranked = F.row_number().over(by_lang.orderBy(F.desc("score"), F.desc("a"), "phrase"))
    out = first.join(spelt, "g").withColumn("rank", ranked).filter(F.col("rank") <= top).join(langs, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

Every text is a reference and is cut into blocks of SIZE words, one at each word. Blocks are indexed
by their hash; the index gives a block's nearest earlier place (by doc_id, then start). A text is
parsed greedily against it: a factor begins at the first block found earlier elsewhere and runs
on while the following block is found at the following place. Factors are therefore at least SIZE words
long, and since each block is looked up for itself, those that straddle two factors are checked too.
Words under factors are duplicates.

Only blocks that can repeat enter the index. Each block names one seed, its GRAM words of smallest
hash; equal blocks name equal seeds. Seeds are sorted first, and blocks whose seed occurs once are
left out. Texts that equal another's are parsed with it once. The index is sorted by (hash, place) and
dealt by ranges of both, so a passage that a third of the documents share spreads over tasks: a block
whose left neighbor has its hash is found earlier, and only the first block of a task needs to know
the last one of the task before.

Blocks are compared by 96 bits of hash. Null text has no words. Rows with equal doc_id are ordered by
a hash of the text; equal rows are one document and get equal results. A null doc_id comes first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worklake.llm import hashing
from worklake.llm.tables import NO_ID, broadcast_if_small, materialize, plain_id, repeated_ids, shared_rows

SIZE = 20
GRAM = 6
#: Keys of copied texts that may be broadcast (16 bytes each); beyond, they meet the texts by shuffle.
BROADCAST_ROWS = 1_000_000

SEEDS = "seed long, d long, x long, pos int"
BLOCKS = "h1 long, h2 int, d long, x long, start int"
MARKED = "d long, x long, start int, rd long, rs int, part long, last boolean, h1 long, h2 int"
PARSED = (
    "d long, x long, n_words long, n_removed long, kept string,"
    " factors array<struct<start: int, length: int, ref: long, ref_start: int>>"
)
_MARKED = pa.schema(
    [("d", pa.int64()), ("x", pa.int64()), ("start", pa.int32()), ("rd", pa.int64()), ("rs", pa.int32()),
     ("part", pa.int64()), ("last", pa.bool_()), ("h1", pa.int64()), ("h2", pa.int32())]
)
_FACTOR = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref", pa.int64()), ("ref_start", pa.int32())])


def _texts(batch: pa.RecordBatch):
    """Row range, bytes, row offsets, word starts and ends and words before each row, a few MB at a time."""
    raw, at = hashing.utf8(batch.column("text"))
    for first, last in hashing.row_blocks(at, 4 * hashing.BLOCK):
        part, begin = raw[at[first] : at[last]], at[first : last + 1] - at[first]
        yield (first, last, part, begin, *hashing.word_spans(part, begin))


def _blocks(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
    """Word hashes, the rows of the first words of all blocks, their places, and the place of each one's seed."""
    h = hashing.spans_hash(part, starts, ends)
    if len(h) < SIZE:
        none = np.zeros(0, np.int64)
        return h, none, none, none
    at = np.flatnonzero(row[: len(h) - SIZE + 1] == row[SIZE - 1 :])
    grams = hashing.windows(h, GRAM)
    width = SIZE - GRAM + 1
    seed = np.empty(len(at), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, width)
    for k in range(0, len(at), 1 << 16):
        seed[k : k + (1 << 16)] = view[at[k : k + (1 << 16)]].argmin(axis=1)
    return h, row[at], at, seed + at


def _seeds(batches):
    names = ["seed", "d", "x", "pos"]
    for batch in batches:
        d, x = (batch.column(n).to_numpy() for n in ("d", "x"))
        for first, last, part, _, starts, ends, before in _texts(batch):
            row = np.repeat(np.arange(last - first), np.diff(before))
            h, _, _, seed = _blocks(part, starts, ends, row)
            seed = np.unique(seed)
            if len(seed):
                mine = row[seed]
                grams = hashing.windows(h, GRAM)[seed].view(np.int64)
                columns = [grams, d[first + mine], x[first + mine], (seed - before[mine]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _candidates(batches):
    names = ["h1", "h2", "d", "x", "start"]
    for batch in batches:
        d, x, places = batch.column("d").to_numpy(), batch.column("x").to_numpy(), batch.column("at")
        for first, last, part, _, starts, ends, before in _texts(batch):
            row = np.repeat(np.arange(last - first), np.diff(before))
            h, mine, at, seed = _blocks(part, starts, ends, row)
            if not len(at):
                continue
            some = places.slice(first, last - first)
            marked = np.zeros(len(h), bool)
            owner = np.repeat(np.arange(last - first), some.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            marked[before[owner] + some.flatten().to_numpy()] = True
            ok = marked[seed]
            at, mine = at[ok], mine[ok]
            if len(at):
                h1 = hashing.windows(h, SIZE)[at].view(np.int64)
                h2 = (hashing.windows(h, SIZE, 1)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                columns = [h1, h2, d[first + mine], x[first + mine], (at - before[mine]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _index(batches):
    """Sorted blocks: each one that equals its left neighbor, with that one's place; the task's first and last."""
    from pyspark import TaskContext

    part, last = TaskContext.get().partitionId(), None

    def end(row: list, is_last: bool) -> pa.RecordBatch:
        h1, h2, d, x, start = row
        return pa.RecordBatch.from_pylist(
            [dict(zip(_MARKED.names, (d, x, start, None, None, part, is_last, h1, h2), strict=True))], schema=_MARKED
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, d, x, start = (batch.column(n).to_numpy() for n in ("h1", "h2", "d", "x", "start"))
        if last is None:
            yield end([c[0].item() for c in (h1, h2, d, x, start)], False)
            last = [c[0].item() for c in (h1, h2, d, x, start)]
        p1, p2, pd, px, ps = (np.r_[np.array([v], c.dtype), c[:-1]] for v, c in zip(last, (h1, h2, d, x, start), strict=True))
        later = (h1 == p1) & (h2 == p2) & ~((d == pd) & (x == px) & (start == ps))
        n = int(later.sum())
        columns = [c[later] for c in (d, x, start, pd, ps)]
        empty = [pa.nulls(n, f.type) for f in list(_MARKED)[5:]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns] + empty, schema=_MARKED)
        last = [c[-1].item() for c in (h1, h2, d, x, start)]
    if last is not None:
        yield end(last, True)


def _factors(found: list[dict]) -> list[tuple[int, int, int, int]]:
    """Factors (start, length, reference, place) from the blocks found, of one document."""
    out: list[list[int]] = []
    for f in sorted(found, key=lambda f: f["start"]):
        start, ref, place = f["start"], f["rd"], f["rs"]
        last = out[-1] if out else None
        if last and start == last[0] + last[1] - SIZE + 1 and ref == last[2] and place == last[3] + last[1] - SIZE + 1:
            last[1] += 1
        else:
            out.append([start, SIZE, ref, place])
    return [tuple(f) for f in out]


def _parse(batches):
    names = ["d", "x", "n_words", "n_removed", "kept", "factors"]
    for batch in batches:
        copies, of, found = batch.column("copy"), batch.column("of"), batch.column("found")
        for first, last, part, begin, starts, ends, before in _texts(batch):
            drop = np.zeros(len(starts) + 1, np.int64)
            factors = []
            for k in range(first, last):
                a, n = int(before[k - first]), int(before[k - first + 1] - before[k - first])
                if copies[k].as_py():
                    mine = [(0, n, of[k].as_py(), 0)] if n >= SIZE else []
                else:
                    mine = _factors(found[k].as_py() or []) if found[k].is_valid else []
                for start, length, _, _ in mine:
                    drop[a + start] += 1
                    drop[a + start + length] -= 1
                factors.append([dict(zip(("start", "length", "ref", "ref_start"), f, strict=True)) for f in mine])
            gone = np.cumsum(drop)[:-1] > 0
            removed = np.r_[0, np.cumsum(gone)]
            stay = np.flatnonzero(~gone)
            # bytes of the words that stay, and after each but its text's last the byte that follows, as a space
            edge = np.zeros(len(part) + 1, np.int8)
            edge[starts[stay]] += 1
            edge[ends[stay]] -= 1
            text = np.cumsum(edge[:-1], dtype=np.int8) > 0
            row = np.repeat(np.arange(last - first), np.diff(before))[stay]
            gap = ends[stay[:-1][row[:-1] == row[1:]]] if len(stay) else stay
            out = part.copy()
            out[gap] = 0x20
            text[gap] = True
            size = np.r_[0, np.cumsum(text)][begin]
            kept = pa.LargeStringArray.from_buffers(last - first, pa.py_buffer(size.astype(np.int64)), pa.py_buffer(out[text]))
            counts = [np.diff(before), removed[before[1:]] - removed[before[:-1]]]
            columns = [batch.column("d").slice(first, last - first), batch.column("x").slice(first, last - first)]
            columns += [pa.array(c.astype(np.int64)) for c in counts]
            columns += [kept.cast(pa.string()), pa.array(factors, pa.list_(_FACTOR))]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def parse(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: d, x (its key), n_words, n_removed, kept (words by single spaces), factors."""
    ids = docs.select(plain_id().alias("d"))
    text = F.col("text").cast("string")
    x = F.coalesce(F.xxhash64(text), F.lit(0)) if repeated_ids(ids) else F.lit(0)
    texts = docs.select(plain_id().alias("d"), x.cast("long").alias("x"), text.alias("text"))

    marks = texts.select("d", "x", F.md5("text").alias("t"))
    firsts = marks.groupBy("t").agg(F.min(F.struct("d", "x")).alias("f"), F.count("*").alias("n")).filter("n > 1")
    copies = (
        marks.join(firsts, "t").filter(F.struct("d", "x") != F.col("f")).select("d", "x", F.col("f.d").alias("of")).distinct()
    )
    copies = materialize(copies, "copies")

    few = broadcast_if_small(copies, BROADCAST_ROWS)
    seeds = shared_rows(texts.join(few, ["d", "x"], "left_anti").mapInArrow(_seeds, SEEDS), "seed")
    places = seeds.groupBy("d", "x").agg(F.collect_set("pos").alias("at"))
    blocks = texts.join(places, ["d", "x"]).mapInArrow(_candidates, BLOCKS)
    order = ["h1", "h2", "d", "x", "start"]
    marked = blocks.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_index, MARKED)
    ends = marked.filter("part is not null")
    before = Window.orderBy("part", "last")  # two rows a task
    seam = ends.withColumn("p", F.lag(F.struct("h1", "h2", "d", "start", "last")).over(before)).filter(
        "not last and p.last and h1 = p.h1 and h2 = p.h2"
    )
    found = (
        marked.filter("part is null")
        .select("d", "x", "start", "rd", "rs")
        .unionByName(seam.select("d", "x", "start", F.col("p.d").alias("rd"), F.col("p.start").alias("rs")))
        .groupBy("d", "x")
        .agg(F.collect_set(F.struct("start", "rd", "rs")).alias("found"))
    )
    # the same exchange of the texts as above comes first, so that it is used again
    return (
        texts.join(found, ["d", "x"], "left")
        .join(few.withColumn("copy", F.lit(True)), ["d", "x"], "left")
        .mapInArrow(_parse, PARSED)
    )


def report(docs: DataFrame) -> DataFrame:
    """One row a document: words, removed words, hash of what is kept."""
    return parse(docs).select(
        F.when(F.col("d") != NO_ID, F.col("d")).alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )

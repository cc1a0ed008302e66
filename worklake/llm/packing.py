"""Packing: shortest pack first, over the histogram of lengths.

Documents are tokenized and cut into pieces of at most SIZE ids. The counts per length (at most SIZE
numbers) go to the driver, where lengths are placed longest first: always into the pack pattern with
the least in it, while it has room, else into a new pack. Patterns carry counts, so the work follows
the number of lengths, not of documents. The patterns' places form a table per length; a piece finds
its own by its rank among the pieces of its length. Ranks come from counts per (length, salt), so a
length that a third of the pieces share is no single task.

Null text is an empty one: a piece with the end id alone. Repeated rows are packed each for itself.
An empty table gives an empty one.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worklake.llm import hashing, tokens
from worklake.llm.tables import materialize

SIZE = 2048
END_ID = 1
#: Pieces of one length and salt, on average over all lengths at most; sets the number of salts.
PER_SALT = 100_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: full ones of `size` ids, then the rest. `with_ids` adds the ids themselves."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    fields = pa.schema([(n, pa.int64()) for n in names] + [("ids", pa.list_(pa.int32()))] * with_ids)

    def pieces(batches):
        encode = tokens.encoder(vocabulary).rows
        end = np.array([end_id], np.uint32)
        for batch in batches:
            rows = []
            raw, at = hashing.utf8(batch.column("text"))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(raw, at), strict=True):
                ids = np.concatenate((ids, end))
                for start in range(0, len(ids), size):
                    part = ids[start : start + size]
                    rows.append((doc_id, start, len(part), tokens.crc32(part), len(ids)) + (part.astype(np.int32),) * with_ids)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(pieces, PIECES + ", ids array<int>" * with_ids)


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a pack, number of such packs), shortest pack first."""
    filled: dict[int, list[list]] = defaultdict(list)  # ids in a pack -> [lengths, count]
    levels: list[int] = []

    def put(level: int, lengths: tuple[int, ...], count: int) -> None:
        if not filled[level]:
            bisect.insort(levels, level)
        filled[level].append([lengths, count])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not levels or levels[0] + length > size:
                each = size // length  # a new pack is the least filled one while it has room
                if left >= each:
                    put(each * length, (length,) * each, left // each)
                if left % each:
                    put(left % each * length, (length,) * (left % each), 1)
                break
            level = levels[0]
            pack = filled[level][-1]
            moved = min(left, pack[1])
            pack[1] -= moved
            left -= moved
            if not pack[1]:
                filled[level].pop()
                if not filled[level]:
                    levels.pop(0)
            put(level + length, (*pack[0], length), moved)
    return [(lengths, count) for level in sorted(filled) for lengths, count in filled[level]]


def places(packs: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: where the pieces of a length go."""
    rows, used, sequence = [], defaultdict(int), 0
    for lengths, count in packs:
        offset = 0
        for length in lengths:
            rows.append((length, used[length], sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """`pieces` with sequence_id and offset; the table is read twice, so give a written one."""
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = places(patterns(histogram, size))
    salts = sum(histogram.values()) // PER_SALT + 1
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    counts = salted.groupBy("length", "__salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "__salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("length", "__salt").orderBy("doc_id", "start", "doc_tokens", "ids_crc32")
    ranked = (
        salted.withColumn("__rank", F.row_number().over(inside) - 1)
        .join(base, ["length", "__salt"])
        .withColumn("__rank", F.col("__rank") + F.col("__base"))
        .drop("__salt", "__base")
    )

    def place(batches):
        key = table[:, 0].astype(np.float64)  # lengths are small; ranks follow within a length
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "__rank"))
            at = np.empty(len(length), np.int64)
            for one in np.unique(length):
                a, b = np.searchsorted(key, [one, one + 1])
                mine = length == one
                at[mine] = a + np.searchsorted(table[a:b, 1], rank[mine], "right") - 1
            columns = {n: batch.column(n) for n in batch.schema.names if n != "__rank"}
            columns["sequence_id"] = pa.array(table[at, 2] + rank - table[at, 1])
            columns["offset"] = pa.array(table[at, 3])
            yield pa.RecordBatch.from_pydict(columns)

    schema = ", ".join(f"`{c}` {t}" for c, t in ranked.dtypes if c != "__rank") + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def sequences(packed: DataFrame, size: int = SIZE, pad_id: int = 0) -> DataFrame:
    """Whole sequences from packed pieces with ids: sequence_id, ids, lengths of its pieces.

    Padded to `size`, unless the pieces fill a power of two.
    """
    parts = packed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("p")
    )
    ids = F.flatten(F.transform("p", lambda p: p["ids"]))
    exact = F.expr("n & (n - 1)") == 0
    return (
        parts.select("sequence_id", ids.alias("ids"), F.transform("p", lambda p: p["length"]).alias("lengths"))
        .withColumn("n", F.size("ids"))
        .withColumn("ids", F.when(exact, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(size) - F.col("n")))))
        .drop("n")
    )


def report(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row a piece, with its place."""
    return pack(materialize(cut(docs, vocabulary), "pieces")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )

"""Exact duplicates by progressive refinement: length, then prefix hash, then hash of the whole text.

Texts are equal when they are identical after each run of ASCII white space becomes one space. A first
scan takes of each text its length and the hash of its first PREFIX characters, nothing else. Lengths
that one text alone has fall out, then pairs of length and prefix that one text alone has. What is left
is told to the second scan as a bitmap of at most MAX_BITS bits, so what is broadcast has a fixed bound:
only texts whose bit is set are hashed as a whole (a bit may be set by chance, which costs a hash and
changes nothing), and only hashes are shuffled, never texts. DataFrame functions only.

Null text counts as empty, and empty texts are equal to each other. Of equal texts the row with the
smallest id stays, a null id comes last, and of rows with the same id and text (ties) exactly one stays.
An empty table gives an empty one. Very long texts are hashed whole. Other columns are carried as they
are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklake.llm.tables import materialize

WHITE_RUN = "[\\x20\\x09-\\x0D]+"
PREFIX = 64
#: Bits for each surviving group, and the least and most bits of the bitmap (16 MB).
BITS_EACH, LEAST_BITS, MAX_BITS = 16, 1 << 15, 1 << 27
#: Bits of one row of the bitmap, as `bitmap_construct_agg` makes them.
ROW_BITS = 1 << 15


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE_RUN, " ")


def _outline(norm: Column) -> tuple[Column, Column]:
    """What the first two steps look at: length, and hash of the prefix."""
    return F.char_length(norm).cast("long"), F.xxhash64(F.substring(norm, 1, PREFIX))


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Pairs (n, p) of length and prefix hash that more than one row has."""
    n, p = _outline(normalised(F.col(text)))
    seen = materialize(docs.select(n.alias("n"), p.alias("p")), "outlines")
    lengths = seen.groupBy("n").count().filter("count > 1").select("n")
    return seen.join(lengths, "n", "left_semi").groupBy("n", "p").count().filter("count > 1").select("n", "p")


def _place(n: Column, p: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(n, p), F.lit(bits))


def bitmap(pairs: DataFrame, most: int = MAX_BITS) -> tuple[DataFrame, int]:
    """The pairs as rows (b, bitmap) of 4 KB, and the number of bits all rows have together."""
    bits = LEAST_BITS
    while bits < min(most, BITS_EACH * pairs.count()):
        bits *= 2
    place = _place(F.col("n"), F.col("p"), bits)
    rows = pairs.select(F.shiftright(place, 15).alias("b"), (place % ROW_BITS).alias("i"))
    return rows.groupBy("b").agg(F.bitmap_construct_agg("i").alias("bitmap")), bits


def _is_set(row: Column, i: Column) -> Column:
    byte = F.conv(F.hex(F.substring(row, F.shiftright(i, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("getbit", byte.cast("long"), (i % 8).cast("int")) == 1, F.lit(False))


def hashed(docs: DataFrame, text: str = "text", most: int = MAX_BITS, **more: Column) -> DataFrame:
    """The columns `more`, a row number `r` and `full`, the hash of the whole text (null: no other text can equal it)."""
    marks, bits = bitmap(materialize(candidates(docs, text), "outlines-kept"), most)
    norm = normalised(F.col(text))
    place = _place(*_outline(norm), bits)
    rows = docs.select(*[c.alias(k) for k, c in more.items()], norm.alias("norm"), place.alias("at"))
    rows = rows.withColumn("b", F.shiftright("at", 15)).join(F.broadcast(materialize(marks, "bitmap")), "b", "left")
    full = F.when(_is_set(F.col("bitmap"), F.col("at") % ROW_BITS), F.unhex(F.sha2("norm", 256)))
    return rows.select(F.monotonically_increasing_id().alias("r"), *more, full.alias("full"))


def decide(rows: DataFrame) -> DataFrame:
    """Written rows (r, id, full, ...) with `keep_id`, `group_size` and `kept`."""
    alone = rows.filter("full is null").select(
        *rows.columns, F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")
    )
    maybe = rows.filter("full is not null")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "r")).alias("first")
    groups = maybe.groupBy("full").agg(first, F.count("*").alias("group_size"))
    told = maybe.join(groups, "full", "left").select(
        *[F.col(c) for c in rows.columns], F.col("first.id").alias("keep_id"), "group_size",
        (F.col("first.r") == F.col("r")).alias("kept"),
    )
    return alone.unionByName(told)


def report(docs: DataFrame) -> DataFrame:
    """One row a document: the row that stays, the size of its group, whether it is this one, digest of the text."""
    digest = F.sha2(normalised(F.col("text")), 256)
    rows = materialize(hashed(docs.select("doc_id", "text"), id=F.col("doc_id"), text_sha256=digest), "hashes")
    return decide(rows).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def keep(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of equal texts, with its own columns."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    own = {c: F.col(c) for c in plain.columns}
    rows = materialize(hashed(plain, at[text], id=F.col(at[doc_id]), **own), "hashed")
    gone = decide(rows.select("r", "id", "full")).filter(~F.col("kept")).select("r")
    return rows.join(gone, "r", "left_anti").select(*plain.columns).toDF(*docs.columns)

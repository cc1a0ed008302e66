"""Benchmark decontamination by a distributed positional inverted index.

Windows of SIZE words (a shorter item is one window) are sought in the training texts:

1. Occurrences of each benchmark word are counted over all training texts; a window with a word that
   never occurs can't occur, but may be near if NEAR of its words do.
2. Postings (word, document, position) of each remaining window's rarest words are stored, each with the
   words around it, as far as a window that holds it can reach: of the rarest one for phrases; for
   proximity, of so many (three of ten different ones) that NEAR of the words can't be without them all.
3. The rarest word's list is joined with the windows, positions adjusted by the word's offset. The lists
   of the window's other words are intersected in place, the second rarest first: the stored
   surroundings say which word stands at each adjusted position. All equal: a phrase match. At least
   NEAR of the window's words around, but not in place: a proximity match.

Only DataFrame functions run here. Benchmark tables are broadcast up to a number of rows; beyond, words
and windows meet by shuffle, and candidates get their surroundings by a join with the texts.

Null text has no words. Items with equal ids count as one, an item without id as `null`. Rows with equal
doc_id are told apart by a hash of the text; equal rows have equal results. An empty benchmark
or corpus gives no matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklake.llm.tables import broadcast_if_small, materialize, plain_id

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The same before upper case is lowered: enough for counting words.
ANY_CASE = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
SIZE = 10
#: Share of a window's different words, in tenths, that makes a proximity match.
NEAR = 8
#: Rows of benchmark words or windows that may be broadcast (about 200 bytes each).
BROADCAST_ROWS = 200_000


def words(text: Column, lower: bool = True) -> Column:
    t = F.coalesce(text.cast("string"), F.lit(""))
    cut = F.split(F.translate(t, UPPER, LOWER), SEPARATORS) if lower else F.split(t, ANY_CASE)
    return F.array_remove(cut, "")


def _keys() -> list[Column]:
    return [plain_id().alias("d"), F.xxhash64(F.col("text").cast("string")).alias("x")]


def windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """item_id (as string) and the words of each of its windows, once each."""
    n = F.size("w")
    at = F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)))
    return (
        benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), words(F.col("text")).alias("w"))
        .filter(n > 0)
        .select("item_id", F.explode(F.transform(at, lambda i: F.slice("w", i, size))).alias("phrase"))
        .distinct()
    )


def _plan(docs: DataFrame, phrases: DataFrame, size: int, near: bool) -> DataFrame:
    """phrase, its words to look up with offsets, the second rarest and offset, `whole` for the word that finds phrases.

    The second rarest is null in windows of one word. Without `near`, only the rarest word is looked up.
    """
    terms = phrases.select("phrase", F.posexplode("phrase").alias("o", "term")).groupBy("phrase", "term").agg(F.min("o").alias("o"))
    wanted = broadcast_if_small(materialize(terms.select("term").distinct(), "terms"), BROADCAST_ROWS)
    seen = (
        docs.select(F.explode(words(F.col("text"))).alias("term"))
        .join(wanted, "term")
        .groupBy("term")
        .agg(F.count("*").alias("n"))
    )
    ranked = (
        terms.join(seen, "term", "left")
        .groupBy("phrase")
        .agg(
            F.count("*").alias("words"),
            F.sort_array(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("n", "o", "term")))).alias("r"),
        )
        .withColumn("whole", F.size("r") == F.col("words"))
    )
    spare = F.size("r") - F.ceil(F.col("words") * NEAR / 10).cast("int") + 1  # so many words meet every set of NEAR
    spare = F.when(F.lit(near) & (F.size("phrase") >= size), F.greatest(spare, F.lit(0))).otherwise(0)
    second = F.get(F.col("r"), F.lit(1))
    return ranked.select(
        "phrase",
        "whole",
        second["term"].alias("term2"),
        second["o"].alias("o2"),
        F.posexplode(F.slice("r", F.lit(1), F.greatest(spare, F.col("whole").cast("int")))).alias("rank", "a"),
    ).select("phrase", F.col("a.term").alias("term"), F.col("a.o").alias("o"), "term2", "o2", (F.col("whole") & (F.col("rank") == 0)).alias("whole"))


def _around(w: Column, pos: Column, size: int) -> Column:
    """Words from `size - 1` before `pos` (or the text's first) to `size - 1` after."""
    first = F.greatest(pos - (size - 1), F.lit(0))
    return F.slice(w, first + 1, pos - first + size)


def matches(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, near: bool = True) -> tuple[DataFrame, DataFrame]:
    """(d, x, phrase, start, kind) of every phrase and (if `near`) proximity match, and (item_id, phrase); both written."""
    held = materialize(windows(benchmark, size), "windows")
    plan = materialize(_plan(docs, held.select("phrase").distinct(), size, near), "window-plan")
    anchors = plan.select("term").distinct()
    small = broadcast_if_small(anchors, BROADCAST_ROWS)
    texts = docs.select(*_keys(), words(F.col("text")).alias("w"))
    if small is anchors:
        at = texts.select("d", "x", F.posexplode("w").alias("pos", "term")).join(anchors, "term")
        postings = at.join(texts, ["d", "x"])
    else:
        postings = texts.select("d", "x", "w", F.posexplode("w").alias("pos", "term")).join(small, "term")
    postings = materialize(postings.select("term", "d", "x", "pos", _around(F.col("w"), F.col("pos"), size).alias("near")), "postings")

    left = F.least(F.col("pos"), F.lit(size - 1))  # index of the posting's own word in `near`
    first = left - F.col("o")  # index at which the window would start
    phrase, around = F.col("phrase"), F.col("near")
    second = F.col("term2").isNull() | (F.get(around, first + F.col("o2")) == F.col("term2"))
    exact = F.col("whole") & (first >= 0) & second & (F.slice(around, F.greatest(first, F.lit(0)) + 1, F.size(phrase)) == phrase)
    common = F.size(F.array_intersect(around, phrase))
    close = F.lit(near) & (F.size(phrase) >= size) & (common * 10 >= F.size(F.array_distinct(phrase)) * NEAR)
    found = (
        postings.join(broadcast_if_small(plan, BROADCAST_ROWS), "term")
        .withColumn("kind", F.when(F.coalesce(exact, F.lit(False)), "phrase").when(close, "near"))
        .filter("kind is not null")
        .select("d", "x", "phrase", (F.col("pos") - F.col("o")).alias("start"), "kind")
    )
    return materialize(found, "matches"), held


def _union(spans: Column) -> Column:
    """Positions under sorted (start, end) spans."""
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["to"]), F.lit(0))).cast("long").alias("n"),
        F.greatest(a["to"], s["end"]).cast("long").alias("to"),
    )
    zero = F.lit(0).cast("long")
    return F.aggregate(spans, F.struct(zero.alias("n"), zero.alias("to")), step, lambda a: a["n"])


def judge(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, near: bool = True) -> DataFrame:
    """d, x, and for documents with a match: n_hit, items (sorted ids), n_near (items near but not met)."""
    found, held = matches(docs, benchmark, size, near)
    met = found.filter("kind = 'phrase'")
    ends = met.groupBy("d", "x", "start").agg(F.max(F.col("start") + F.size("phrase")).alias("end"))
    hits = (
        ends.groupBy("d", "x")
        .agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))).alias("s"))
        .select("d", "x", _union(F.col("s")).alias("n_hit"))
    )
    by_item = found.select("d", "x", "phrase", "kind").distinct().join(held, "phrase")
    kinds = by_item.groupBy("d", "x", "item_id").agg(F.max("kind").alias("kind"))  # 'phrase' after 'near'
    items = kinds.groupBy("d", "x").agg(
        F.sort_array(F.collect_list(F.when(F.col("kind") == "phrase", F.col("item_id")))).alias("items"),
        F.count(F.when(F.col("kind") == "near", 1)).alias("n_near"),
    )
    return items.join(hits, ["d", "x"], "left")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row a document: words, hit words, items met, items near, verdict."""
    texts = docs.select("doc_id", *_keys(), F.size(words(F.col("text"), lower=False)).cast("long").alias("n_words"))
    hit = F.coalesce("n_hit", F.lit(0))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return texts.join(judge(docs, benchmark), ["d", "x"], "left").select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )


def keep(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no window occurs, with their own columns."""
    hit = judge(docs, benchmark, near=False).filter("n_hit > 0").select("d", "x")
    return (
        docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_keys())
        .join(hit, ["d", "x"], "left_anti")
        .select("row.*")
    )

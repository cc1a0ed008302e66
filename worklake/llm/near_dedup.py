"""Near duplicates by HyperMinHash sketches, banded.

A document is its set of different shingles of `size` words (hashed to 64 bits; fewer words are one shingle). The hashes fall into BUCKETS
buckets; a register keeps of the smallest hash in its bucket the number of leading zeros and
MANTISSA bits after them, in 16 bits. An empty bucket takes the register of a bucket that a fixed
random order names. BANDS bands of registers are candidates' keys: at a similarity of 0.8 a pair
shares none with a probability below 1e-6, and pairs below 0.1 share one as rarely.

Sets that are equal are one candidate. In a band each member is paired with one leader, the one that
shares bands most often, not with all others; pairs are estimated from their registers (corrected for
chance collisions), then verified on the full sets, and verified links joined into components. Where a
band's members are then still in several components, those outside the largest one meet all its members
in blocks of bounded size. So every candidate pair is verified or already connected.

Null text, or one without words, has an empty set and no links. A row without doc_id has no links
either (component null, kept). In `report`, rows with equal doc_id are one node. In `keep`, each row is
one: of repeated rows one stays, rows with one id and unlike texts all stay. The smallest id of a
component stands for it (ties: any). Very long texts are sets like others, an empty table gives an
empty one, and other columns are carried whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklake.llm import hashing
from worklake.llm.tables import broadcast_if_small, materialize, repeated_ids, shared_rows, small_batches

#: Words of a shingle, unless the caller says otherwise.
SHINGLE = 2
LEAST, OF = 80, 100  # similarity, as a fraction
BANDS, ROWS = 48, 6
BUCKETS = BANDS * ROWS
MANTISSA = 10
#: Keys (16 bytes each) that may be broadcast; beyond, they meet sketches and texts by shuffle.
BROADCAST_ROWS = 1_000_000
#: Pairs up to this number are sent to the sets they name, instead of shuffling the sets.
FEW_PAIRS = 5_000
#: Sets on either side of a block in which all are compared.
PER_BLOCK = 256
#: Estimated similarity below which a pair is not verified: six standard deviations under 0.8.
ESTIMATE = 0.8 - 6 * (0.16 / BUCKETS) ** 0.5
#: Chance that registers of unlike sets agree: leading zeros agree once in three, mantissas in 2^MANTISSA.
CHANCE = 1 / (3 << MANTISSA)

_EDGES = (np.arange(BUCKETS, dtype=object) * (1 << 64) // BUCKETS).astype(np.uint64)
_ORDER = np.random.default_rng(7).permuted(np.tile(np.arange(BUCKETS), (BUCKETS, 1)), axis=1).argsort(axis=1)

SKETCH = "d long, x long, n_shingles long, sid binary, registers binary"


def shingles(batch: pa.RecordBatch, size: int):
    """Row number and sorted distinct shingle hashes of each row."""
    raw, at = hashing.utf8(batch.column("text"))
    for first, last in hashing.row_blocks(at):
        part, begin = hashing.LOWER[raw[at[first] : at[last]]], at[first : last + 1] - at[first]
        starts, ends, before = hashing.word_spans(part, begin)
        h = hashing.spans_hash(part, starts, ends)
        found = hashing.windows(h, size)
        for k in range(last - first):
            a, b = int(before[k]), int(before[k + 1])
            yield first + k, np.unique(found[a : b - size + 1]) if b - a >= size else hashing.windows(h[a:b], max(1, b - a))


def registers(values: np.ndarray) -> np.ndarray:
    """Registers of a set of sorted hashes."""
    first = np.searchsorted(values, _EDGES)
    full = first < np.r_[first[1:], len(values)]
    rest = (values[first[full]] - _EDGES[full]) * np.uint64(BUCKETS)
    part, power = np.frexp(rest.astype(np.float64))
    zeros = np.clip(64 - power, 0, 63)
    bits = np.clip((2 * part - 1) * (1 << MANTISSA), 0, (1 << MANTISSA) - 1).astype(np.int64)
    out = np.zeros(BUCKETS, np.uint16)
    out[full] = np.minimum((zeros << MANTISSA) + bits, 0xFFFF)
    given = np.flatnonzero(full)
    empty = np.flatnonzero(~full)
    if len(given) and len(empty):
        out[empty] = out[given[_ORDER[np.ix_(empty, given)].argmin(axis=1)]]
    return out


def _sketch(batches, size):
    for batch in batches:
        rows = []
        for k, values in shingles(batch, size):
            n = len(values)
            total = hashing.mix(values).sum(dtype=np.uint64) if n else np.uint64(0)
            mixed = np.bitwise_xor.reduce(hashing.mix(values, 99)) if n else np.uint64(0)
            rows.append((n, total.tobytes() + mixed.tobytes(), registers(values).tobytes() if n else b"", total.view(np.int64)))
        if rows:
            n, sid, regs, total = zip(*rows, strict=True)
            x = batch.column("x") if "x" in batch.schema.names else None
            tie = pa.array(np.where(x.to_numpy(zero_copy_only=False), np.array(total), 0))
            columns = [batch.column("d"), tie, pa.array(n, pa.int64()), pa.array(sid, pa.binary()), pa.array(regs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["d", "x", "n_shingles", "sid", "registers"])


def sketch(texts: DataFrame, repeated: bool, size: int = SHINGLE) -> DataFrame:
    """Sketch of each row (d, text); x tells sets of one id apart, 0 where ids are unique."""
    return texts.select("d", F.lit(repeated).alias("x"), "text").mapInArrow(lambda batches: _sketch(batches, size), SKETCH)


def _estimate(batches):
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint16).reshape(-1, BUCKETS) for n in ("ra", "rb"))
        near = ((a == b).mean(axis=1) - CHANCE) / (1 - CHANCE) >= ESTIMATE
        yield batch.select(["d", "x", "e", "y"]).filter(pa.array(near))


def _sets(batches, size):
    for batch in batches:
        found = [values.tobytes() for _, values in shingles(batch, size)]
        yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("x"), pa.array(found, pa.binary())], names=["d", "x", "s"])


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are similar enough."""
    if min(len(a), len(b)) * OF < max(len(a), len(b)) * LEAST:
        return False
    at = np.searchsorted(a, b)
    both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return OF * both >= LEAST * (len(a) + len(b) - both)


def _verify(batches):
    for batch in batches:
        ok = [
            _similar(*(np.frombuffer(v.as_buffer(), np.uint64) for v in pair))
            for pair in zip(batch.column("s"), batch.column("t"), strict=True)
        ]
        yield batch.select(["d", "e"]).filter(pa.array(ok, pa.bool_()))


def _block(rows: pa.Table) -> pa.Table:
    """Links between the asking rows of a block and its others, across components."""
    rows = rows.combine_chunks()
    ask = rows.column("ask").to_numpy(zero_copy_only=False)
    d, label = rows.column("d").to_numpy(), rows.column("label").to_numpy()
    regs = np.frombuffer(b"".join(rows.column("registers").to_pylist()), np.uint16).reshape(-1, BUCKETS)
    sets = [np.frombuffer(v, np.uint64) for v in rows.column("s").to_pylist()]
    others = np.flatnonzero(~ask)
    found = []
    for k in np.flatnonzero(ask):
        far = others[label[others] != label[k]]
        share = ((regs[far] == regs[k]).mean(axis=1) - CHANCE) / (1 - CHANCE)
        found += [(d[k], d[j]) for j in far[share >= ESTIMATE] if _similar(sets[k], sets[j])]
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.table({"d": pa.array(a, pa.int64()), "e": pa.array(b, pa.int64())})


class Links:
    """Verified links between the sets of a corpus."""

    def __init__(self, texts: DataFrame, size: int = SHINGLE):
        """`texts`: d (not null), text."""
        small_batches(texts.sparkSession)
        self.repeated = repeated_ids(texts.select("d"))
        self.sketches = materialize(sketch(texts, self.repeated, size), "sketches")
        some = self.sketches.filter("n_shingles > 0")
        firsts = some.groupBy("sid").agg(F.min(F.struct("d", "x")).alias("f"), F.count("*").alias("n")).filter("n > 1")
        copies = materialize(
            some.join(firsts, "sid").filter(F.struct("d", "x") != F.col("f")).select("d", "x", F.col("f.d").alias("e")).distinct(), "copies"
        )
        self.members = copies.select("d", "e")
        sets = some.join(broadcast_if_small(copies, BROADCAST_ROWS), ["d", "x"], "left_anti")
        #: (band, d, x) of the bands that two sets or more share.
        self.bands = materialize(shared_rows(_bands(sets), "band"), "bands")
        nodes = materialize(self.bands.select("d", "x").distinct(), "nodes")
        few = broadcast_if_small(nodes, BROADCAST_ROWS)
        self.registers = materialize(sets.join(few, ["d", "x"]).select("d", "x", "n_shingles", "registers").dropDuplicates(["d", "x"]), "registers")
        if self.repeated:
            keyed = texts.select("d", F.lit(True).alias("x"), "text")
            full = keyed.mapInArrow(lambda b: _keyed_sets(b, size), "d long, x long, s binary").join(few, ["d", "x"]).dropDuplicates(["d", "x"])
        else:
            full = texts.join(few, "d").select("d", "x", "text").mapInArrow(lambda b: _sets(b, size), "d long, x long, s binary")
        self.full = materialize(full, "full-sets")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (d, x, e, y) that are similar enough, as (d, e); written."""

        def other(df: DataFrame) -> DataFrame:
            names = {"d": "e", "x": "y", "n_shingles": "nb", "registers": "rb", "s": "t"}
            return df.select(*[F.col(c).alias(names[c]) for c in df.columns])

        pairs = materialize(pairs.distinct(), "pairs")
        small = pairs.limit(FEW_PAIRS + 1).count() <= FEW_PAIRS
        pair = ["d", "x", "e", "y"]

        def both(pairs: DataFrame, values: DataFrame) -> DataFrame:
            """Pairs with the values of either side; few pairs go to the values, not the other way."""
            if small:
                named = F.broadcast(pairs)
                return named.join(values, ["d", "x"]).join(named.join(other(values), ["e", "y"]), pair)
            return pairs.join(values, ["d", "x"]).join(other(values), ["e", "y"])

        sized = F.least("n_shingles", "nb") * OF >= F.greatest("n_shingles", "nb") * LEAST
        likely = both(pairs, self.registers).filter(sized).select(*pair, F.col("registers").alias("ra"), "rb")
        likely = materialize(likely.mapInArrow(_estimate, "d long, x long, e long, y long"), "likely")
        checked = both(likely, self.full).select("d", "e", "s", "t")
        return materialize(checked.mapInArrow(_verify, "d long, e long"), "links")

    def _popular_first(self) -> DataFrame:
        """Each band's members, paired with the one that shares bands most often: a text that others were made from."""
        held = self.bands.groupBy("band").agg(F.count("*").alias("n"))
        weight = self.bands.join(held, "band").groupBy("d", "x").agg(F.sum("n").alias("w"))
        return _stars(self.bands.join(weight, ["d", "x"]), -F.col("w"))

    def components(self) -> DataFrame:
        """(node, label) of every id with a link; label is the smallest id it is connected with."""
        links = self.members.union(self.verified(self._popular_first()))
        labels = components(links)
        mixed = self._mixed(labels)
        if mixed.isEmpty():
            return labels
        rest = self._rest(mixed)
        return labels if rest.isEmpty() else components(links.union(rest))

    def _rest(self, mixed: DataFrame) -> DataFrame:
        """Verified links between different components that share a band; written.

        A band's largest component is its family; members of others are strays of that family. All
        strays of a family meet all its members (and each other) in blocks of bounded size, in which
        pairs are estimated and verified; only links come out.
        """
        main = mixed.groupBy("band").agg(F.max(F.struct("size", "label")).alias("m")).select("band", F.col("m.label").alias("family"))
        held = mixed.join(main, "band").select("family", "d", "x", "label").distinct()
        held = materialize(held.withColumn("stray", F.col("label") != F.col("family")), "families")
        counts = held.groupBy("family").agg(F.count("*").alias("all"), F.count(F.when(F.col("stray"), 1)).alias("strays"))
        parts = lambda n: F.ceil(F.col(n) / PER_BLOCK).cast("int")
        held = held.join(counts.select("family", parts("all").alias("ca"), parts("strays").alias("cs")), "family")
        mine = lambda n: F.pmod(F.xxhash64("d", "x"), F.col(n)).cast("int")
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        asked = held.filter("stray").select("family", "d", "x", "label", F.lit(True).alias("ask"), mine("cs").alias("i"), upto("ca").alias("j"))
        given = held.select("family", "d", "x", "label", F.lit(False).alias("ask"), upto("cs").alias("i"), mine("ca").alias("j"))
        blocks = asked.union(given).join(self.registers, ["d", "x"]).join(self.full, ["d", "x"])
        met = blocks.select("family", "i", "j", "d", "label", "ask", "registers", "s").groupBy("family", "i", "j")
        return materialize(met.applyInArrow(_block, "d long, e long"), "links")

    def _mixed(self, labels: DataFrame) -> DataFrame:
        """Members, with label and size of its component, of the bands that several components share; written."""
        sized = labels.join(labels.groupBy("label").agg(F.count("*").alias("size")), "label")
        named = self.bands.join(sized, self.bands.d == sized.node, "left").select(
            "band", "d", "x", F.coalesce("label", "d").alias("label"), F.coalesce("size", F.lit(1)).alias("size")
        )
        several = named.groupBy("band").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a != b").select("band")
        return materialize(named.join(several, "band"), "mixed")


def _bands(sets: DataFrame) -> DataFrame:
    key = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda b: F.xxhash64(b, F.substring(F.col("registers"), b * (2 * ROWS) + 1, F.lit(2 * ROWS))),
    )
    return sets.select(F.explode(key).alias("band"), "d", "x")


def _stars(bands: DataFrame, order: Column) -> DataFrame:
    """Each band's members, paired with the one that comes first in `order`."""
    lead = bands.groupBy("band").agg(F.min(F.struct(order.alias("o"), "d", "x")).alias("l"))
    other = (F.col("d") != F.col("l.d")) | (F.col("x") != F.col("l.x"))
    return bands.join(lead, "band").filter(other).select("d", "x", F.col("l.d").alias("e"), F.col("l.x").alias("y"))


def _keyed_sets(batches, size):
    """Sets of rows whose ids repeat, with the tie of the sketch."""
    for batch in batches:
        ties, found = [], []
        for _, values in shingles(batch, size):
            ties.append(int(hashing.mix(values).sum(dtype=np.uint64).view(np.int64)) if len(values) else 0)
            found.append(values.tobytes())
        columns = [batch.column("d"), pa.array(ties, pa.int64()), pa.array(found, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["d", "x", "s"])


def components(links: DataFrame) -> DataFrame:
    """(node, label) for undirected links (d, e): label is the smallest node of the component. Written.

    Each round hangs every node under its smallest neighbor, follows these pointers a few steps, and goes
    on with the links between where they lead.
    """
    pairs = links.filter("d != e").select(F.greatest("d", "e").alias("u"), F.least("d", "e").alias("v"))
    edges = materialize(pairs.distinct(), "edges")
    labels = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct().withColumn("label", F.col("node"))
    while not edges.isEmpty():
        hang = edges.groupBy("u").agg(F.min("v").alias("v"))
        for _ in range(2):
            up = hang.select(F.col("u").alias("v"), F.col("v").alias("w"))
            hang = hang.join(up, "v", "left").select("u", F.coalesce("w", "v").alias("v"))
        hang = materialize(hang, "hang")
        to = hang.select(F.col("u").alias("label"), F.col("v").alias("root"))
        labels = labels.join(to, "label", "left").select("node", F.coalesce("root", "label").alias("label"))
        a = hang.select("u", F.col("v").alias("a"))
        b = hang.select(F.col("u").alias("v"), F.col("v").alias("b"))
        ends = edges.join(a, "u", "left").join(b, "v", "left").select(F.coalesce("a", "u").alias("a"), F.coalesce("b", "v").alias("b"))
        edges = materialize(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    return materialize(labels, "labels")


def _find(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), F.col("text").cast("string").alias("text")).filter("d is not null")
    links = Links(texts, size)
    return links.sketches, links.components()


def report(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One row a document: size of its set, its component, whether it stands for it."""
    sketches, labels = _find(docs, size)
    label = F.coalesce("label", "d")
    rows = sketches.join(labels, sketches.d == labels.node, "left").select(
        F.col("d").alias("doc_id"), "n_shingles", label.alias("component_id"), (F.col("d") == label).alias("kept")
    )
    unnamed = docs.filter("doc_id is null").select(F.lit(None).cast("long").alias("d"), F.col("text").cast("string").alias("text"))
    loose = sketch(unnamed, False, size).select(
        "d", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")
    )
    return rows.unionByName(loose.withColumnRenamed("d", "doc_id"))


def keep(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One document of each component, with the columns of `docs`."""
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*at.values())  # names of any kind
    plain = plain.withColumn("d", F.col(at["doc_id"]).cast("long"))
    if repeated_ids(plain.select("d").filter("d is not null")):  # each row is a node: numbered in the order of ids
        ordered = plain.repartitionByRange("d", F.xxhash64(at["text"])).sortWithinPartitions("d")
        numbered = F.when(F.col("d").isNotNull(), F.monotonically_increasing_id())
        plain = materialize(ordered.withColumn("d", numbered), "numbered")
    _, labels = _find(plain.select(F.col("d").alias("doc_id"), F.col(at["text"]).alias("text")), size)
    gone = materialize(labels.filter("node != label").select(F.col("node").alias("d")), "gone")
    rest = plain.join(broadcast_if_small(gone, BROADCAST_ROWS), "d", "left_anti")
    return rest.select(*at.values()).toDF(*docs.columns)

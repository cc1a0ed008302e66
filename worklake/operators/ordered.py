"""Ordered operators that stay parallel when one key holds most of the rows.

A plain window puts a whole key into one task. Here every key is cut into buckets of its order
column; windows run per (key, bucket), and one small row per (key, bucket) carries what the next
buckets need. Results equal the unbucketed window.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

ROW_BITS = 33
NULL_SPREAD = 1 << 16


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder named by the cluster; a local one only where none is set (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = os.path.join(tempfile.gettempdir(), "worklake-checkpoints")
    return shared


def materialize(df: DataFrame, name: str = "step", by: tuple[str, ...] = ()) -> DataFrame:
    """Cuts lineage by writing a table in the shared folder (one folder per value of `by`) and reading it back."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_known(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join on keys that are null for many left rows, which can match nothing.

    Those rows are dealt by a hash of their values, so they never meet in one task; all other rows go
    by their keys alone. The right side's part of the extra key is always 0, in a form that the
    optimizer does not fold, since a constant would drop out of the shuffle's keys.
    """
    unknown = F.lit(False)
    for c in on:
        unknown = unknown | F.col(c).isNull()
    plain = [f"`{f.name}`" for f in left.schema.fields if isinstance(f.dataType, AtomicType) and f.dataType.typeName() != "variant"]
    spread = F.when(unknown, F.pmod(F.xxhash64(*plain), F.lit(NULL_SPREAD))).otherwise(F.lit(0).cast("long"))
    return (
        left.withColumn("__spread", spread)
        .join(right.withColumn("__spread", F.pmod(F.xxhash64(*on), F.lit(1))), [*on, "__spread"], "left")
        .drop("__spread")
    )


def fill_last(
    df: DataFrame,
    keys: list[str],
    bucket: Column,
    order: list[str],
    values: dict[str, Column],
    strict: bool = False,
    descending: bool = False,
) -> DataFrame:
    """Adds, per output name, the last non-null value at or before the row in its key's order.

    `strict` looks only at rows before; `descending` walks the order (and the buckets) backwards,
    giving the first value at or after. Keys must not be null.
    """
    direction = F.desc if descending else F.asc
    tmp = {out: f"__v_{out}" for out in values}
    base = df.withColumn("__b", bucket)
    for out, value in values.items():
        base = base.withColumn(tmp[out], value)
    near = (
        Window.partitionBy(*keys, "__b")
        .orderBy(*[direction(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    )
    edge = F.min_by if descending else F.max_by
    tails = base.groupBy(*keys, "__b").agg(
        *[
            edge(v, F.when(F.col(v).isNotNull(), F.struct(*order))).alias(f"{v}_tail")
            for v in tmp.values()
        ]
    )
    before = (
        Window.partitionBy(*keys)
        .orderBy(direction("__b"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = tails.select(
        *keys,
        "__b",
        *[F.last(f"{v}_tail", ignorenulls=True).over(before).alias(f"{v}_far") for v in tmp.values()],
    )
    local = base.select(
        "*", *[F.last(v, ignorenulls=True).over(near).alias(f"{v}_near") for v in tmp.values()]
    )
    joined = local.join(carried, [*keys, "__b"], "left")
    return joined.select(
        *df.columns,
        *[
            F.coalesce(f"{v}_near", f"{v}_far").alias(out)
            for out, v in tmp.items()
        ],
    )


def asof(
    probes: DataFrame,
    events: DataFrame,
    keys: list[str],
    at: list[str],
    values: list[str],
    width: int,
    forward: bool = False,
    strict: bool = False,
) -> DataFrame:
    """Per probe, each value column of the nearest event of its key that has the value.

    Backward: the last event at or before the probe; forward: the first at or after. Both sides
    carry `keys` and the order columns `at` (the first one numeric, cut into buckets of `width`);
    callers pass distinct probes. One shuffle of the union, no pairs.
    """
    first_tag, last_tag = (1, 0) if strict ^ forward else (0, 1)
    cols = [*keys, *at]
    both = probes.select(
        *cols, *[F.lit(None).cast(events.schema[v].dataType).alias(v) for v in values],
        F.lit(last_tag).alias("__probe"), F.lit(True).alias("__is_probe"),
    ).unionByName(
        events.select(
            *cols, *values, F.lit(first_tag).alias("__probe"), F.lit(False).alias("__is_probe")
        )
    )
    found = fill_last(
        both,
        keys,
        F.floor(F.col(at[0]) / F.lit(width)),
        [*at, "__probe"],
        {f"found_{v}": F.col(v) for v in values},
        descending=forward,
    )
    return found.where("__is_probe").select(*cols, *[F.col(f"found_{v}").alias(v) for v in values])


def activity_runs(
    df: DataFrame, keys: list[str], at: list[str], gap: int
) -> DataFrame:
    """Per key, maximal runs whose neighbouring events are at most `gap` apart.

    Events inside one bucket of width `gap` always share a run, so rows are first reduced to one
    per (key, bucket) map-side; only those reach the window.
    """
    point = F.struct(*at)
    slots = df.groupBy(*keys, F.floor(F.col(at[0]) / F.lit(gap)).alias("__slot")).agg(
        F.min(point).alias("first"), F.max(point).alias("last"), F.count("*").alias("__n")
    )
    w = Window.partitionBy(*keys).orderBy("__slot")
    prev = F.lag(f"last.{at[0]}").over(w)
    marked = slots.withColumn(
        "__new", F.when(prev.isNull() | (F.col(f"first.{at[0]}") - prev > gap), 1).otherwise(0)
    )
    numbered = marked.withColumn(
        "run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    return numbered.groupBy(*keys, "run").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("__n").alias("events")
    )


def spread_runs(df: DataFrame, keys: list[str], at: str, gap: int, slots: int = 4096) -> DataFrame:
    """`activity_runs` for keys that may hold most of the time line, even one key for all rows.

    No window covers more than `slots` occupied slots of a key; one row per such stretch is carried on.
    """
    occupied = df.groupBy(*keys, F.floor(F.col(at) / F.lit(gap)).alias("__slot")).agg(
        F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("__n")
    )
    bucket = F.floor(F.col("__slot") / F.lit(slots))
    seen = fill_last(occupied, keys, bucket, ["__slot"], {"__prev": F.col("last")}, strict=True)
    starts = F.col("__prev").isNull() | (F.col("first") - F.col("__prev") > gap)
    opened = seen.withColumn("__start", F.when(starts, F.col("first")))
    return fill_last(opened, keys, bucket, ["__slot"], {"run": F.col("__start")}).groupBy(*keys, "run").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("__n").alias("events")
    )


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rn", salts: int = 64) -> DataFrame:
    """First n rows per key; a hot key is cut down in `salts` tasks before its final ranking."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    first = Window.partitionBy(*keys, "__salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    cut = salted.withColumn("__rn", F.row_number().over(first)).where(F.col("__rn") <= n)
    return (
        cut.drop("__rn", "__salt")
        .withColumn(rank, F.row_number().over(final))
        .where(F.col(rank) <= n)
    )


def collapse_runs(
    df: DataFrame, keys: list[str], bucket: Column, order: list[str], same: Column, aggs: list[Column]
) -> DataFrame:
    """Gaps and islands: merges consecutive rows whose `same` value is equal and not null.

    A null `same` value never merges. Groups are (keys, order values of the run's first row).
    """
    marked = df.withColumn("__same", F.struct(same.alias("s")))
    with_prev = fill_last(marked, keys, bucket, order, {"__prev": F.col("__same")}, strict=True)
    joins = F.coalesce(F.col("__prev.s") == F.col("__same.s"), F.lit(False))
    starts = ~joins
    first = with_prev.withColumn("__start", F.when(starts, F.struct(*order)))
    runs = fill_last(first, keys, bucket, order, {"run_start": F.col("__start")})
    return runs.groupBy(*keys, "run_start").agg(*aggs)


def pick_rank(
    df: DataFrame, keys: list[str], value: str, shares: dict[str, float], width: float
) -> DataFrame:
    """Per key, `sorted[floor(n * share)]` for several shares without collecting the values.

    Rows become counts per distinct value, then per bin of `width`; bins are ranked, and only the
    bin holding a wanted rank is opened.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    counts = counts.withColumn("__bin", F.floor(F.col(value) / F.lit(width)))
    bins = counts.groupBy(*keys, "__bin").agg(F.sum("__c").alias("__bc"))
    by_key = Window.partitionBy(*keys)
    upto = by_key.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(
        *keys,
        "__bin",
        "__bc",
        F.coalesce(F.sum("__bc").over(upto), F.lit(0)).alias("__skip"),
        F.sum("__bc").over(by_key).alias("__n"),
    )
    wanted = F.array(
        *[F.struct(F.lit(n).alias("name"), F.floor(F.col("__n") * s).alias("rank")) for n, s in shares.items()]
    )
    hit = bins.select("*", F.explode(wanted).alias("__w")).where(
        (F.col("__w.rank") >= F.col("__skip"))
        & (F.col("__w.rank") < F.col("__skip") + F.col("__bc"))
    )
    inside = Window.partitionBy(*keys, "__bin", "__w.name").orderBy(value)
    opened = hit.join(counts, [*keys, "__bin"]).withColumn(
        "__upto", F.col("__skip") + F.sum("__c").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    chosen = opened.where(
        (F.col("__upto") > F.col("__w.rank")) & (F.col("__upto") - F.col("__c") <= F.col("__w.rank"))
    )
    return chosen.groupBy(*keys).agg(
        F.max("__n").alias("n"),
        *[F.max(F.when(F.col("__w.name") == n, F.col(value))).alias(n) for n in shares],
    )


def positions(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Zero-based sorted position of each distinct string per key.

    Rows are sorted once by ranges of (keys, value) and written; a row's place in its range plus the
    rows of its key in earlier ranges is its position. Only counts per key and range are joined back,
    so neither one key nor strings that begin alike end up in one task.
    """
    mask = (1 << ROW_BITS) - 1
    placed = materialize(
        df.repartitionByRange(*keys, value)
        .sortWithinPartitions(*keys, value)
        .withColumn("__p", F.spark_partition_id())
        .withColumn("__r", F.monotonically_increasing_id().bitwiseAND(F.lit(mask))),
        "positions",
    )
    ranges = placed.groupBy(*keys, "__p").agg(F.min("__r").alias("__first"), F.count("*").alias("__c"))
    before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    shifted = ranges.select(*keys, "__p", "__first", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__skip"))
    return (
        placed.join(shifted, [*keys, "__p"])
        .withColumn(out, F.col("__r") - F.col("__first") + F.col("__skip"))
        .drop("__p", "__r", "__first", "__skip")
    )

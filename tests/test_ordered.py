"""Bucketed operators against plain windows, with one key holding most rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from worklake.operators import ordered as O


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.5 else f"k{rng.randrange(40)}"
        rows.append((key, rng.randrange(20_000), i, rng.choice([None, None, "a", "b", "c"])))
    return spark.createDataFrame(rows, "k string, t long, id long, v string").cache()


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("descending", [False, True])
def test_fill_last(skewed, strict, descending):
    got = O.fill_last(
        skewed, ["k"], F.floor(F.col("t") / 500), ["t", "id"], {"f": F.col("v")}, strict, descending
    )
    d = F.desc if descending else F.asc
    w = Window.partitionBy("k").orderBy(d("t"), d("id")).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    want = skewed.withColumn("f", F.last("v", ignorenulls=True).over(w))
    assert rows(got, "id", "f") == rows(want, "id", "f")


def test_top_n(skewed):
    order = [F.desc("t"), F.desc("id")]
    want = skewed.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(*order))).where("rn <= 7")
    assert rows(O.top_n(skewed, ["k"], order, 7), "id", "rn") == rows(want, "id", "rn")


def test_pick_rank(skewed):
    got = {r["k"]: (r["n"], r["m"], r["p"]) for r in O.pick_rank(skewed, ["k"], "t", {"m": 0.5, "p": 0.9}, 100).collect()}
    data = {}
    for r in skewed.collect():
        data.setdefault(r["k"], []).append(r["t"])
    want = {k: (len(v), sorted(v)[int(len(v) * 0.5)], sorted(v)[int(len(v) * 0.9)]) for k, v in data.items()}
    assert got == want


def test_activity_runs(skewed):
    got = {(r["k"], r["first"]["t"], r["last"]["t"], r["events"]) for r in O.activity_runs(skewed, ["k"], ["t"], 60).collect()}
    bounded = {(r["k"], r["first"], r["last"], r["events"]) for r in O.spread_runs(skewed, ["k"], "t", 60, slots=3).collect()}
    data, want = {}, set()
    for r in skewed.collect():
        data.setdefault(r["k"], []).append(r["t"])
    for k, ts in data.items():
        ts.sort()
        start, n = ts[0], 1
        for a, b in zip(ts, ts[1:]):
            if b - a > 60:
                want.add((k, start, a, n))
                start, n = b, 0
            n += 1
        want.add((k, start, ts[-1], n))
    assert got == bounded == want


def test_positions(spark):
    rng = random.Random(1)
    names = sorted({f"src/{rng.choice('abc')}{'x' * rng.randrange(20)}/{rng.randrange(90)}" for _ in range(400)})
    df = spark.createDataFrame([(n, "g") for n in names], "p string, g string")
    got = {r["p"]: r["pos"] for r in O.positions(df, ["g"], "p", "pos").collect()}
    assert got == {n: i for i, n in enumerate(names)}


def test_positions_of_names_that_begin_alike(spark):
    df = spark.range(3000).select(F.lit("g").alias("g"), F.format_string("one/long/common/folder/%06d", "id").alias("p"), "id")
    df = df.unionByName(spark.createDataFrame([("h", "b", -1), ("h", "a", -2)], "g string, p string, id long"))
    got = {(r["g"], r["id"]): r["pos"] for r in O.positions(df, ["g"], "p", "pos").collect()}
    assert got == {**{("g", i): i for i in range(3000)}, ("h", -2): 0, ("h", -1): 1}


def test_null_keys_spread(spark):
    """95 of 100 rows have no key: nothing is lost, and no task of the join holds them all."""
    left = spark.range(20_000).select(
        "id", F.when(F.col("id") % 20 == 0, F.col("id") % 7).alias("k"), F.array("id").alias("more"), F.lit("r").alias("repo")
    )
    right = spark.createDataFrame([(n, "r", f"v{n}") for n in range(5)] + [(None, "r", "no"), (None, None, "none")], "k long, repo string, v string")
    old = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for c, v in zip(old, ("-1", "false")):
        spark.conf.set(c, v)
    try:
        joined = O.join_known(left, right, ["repo", "k"])
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        got = joined.collect()
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert joined.columns == left.join(right, ["repo", "k"], "left").columns
    want = {r["id"]: f"v{r['k']}" if r["k"] is not None and r["k"] < 5 else None for r in left.collect()}
    assert len(got) == 20_000 and {r["id"]: r["v"] for r in got} == want
    assert len(sizes) == 4 and max(sizes) < 2 * 20_000 / 4


def test_checkpoint_dir_is_read_from_the_session(spark):
    assert O.checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")

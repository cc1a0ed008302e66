"""Incremental runs against full runs, and what they leave alone."""

import json
import os

import pytest
from pyspark.sql import functions as F

from worklake.operators import incremental as N
from worklake.operators import ingest as I
from worklake.operators import matching as M
from worklake.operators import sync as Y
from worklake.sources import dialect_a as A


def write(path, rows):
    path.write_text("\n".join(json.dumps(x) for x in rows) + "\n")


def line(session, n):
    return {"type": "user", "sessionId": session, "uuid": f"{session}-{n}", "timestamp": f"2025-01-01T00:{n:02d}:00Z", "message": {"content": "hi"}}


def parts(folder):
    """Data files of each partition."""
    found = {}
    for where, _, names in os.walk(folder):
        found.update({os.path.relpath(where, folder): sorted(n for n in names if n.endswith(".parquet"))} if "=" in where else {})
    return {k: v for k, v in found.items() if v}


def test_only_changed_files_are_read(spark, tmp_path):
    root, store = tmp_path / "in", str(tmp_path / "store")
    root.mkdir()
    for k in range(6):
        write(root / f"{k}.jsonl", [line(f"s{k}", n) for n in range(3)])
    reads = []

    def parse(lines):
        reads.append(sorted(os.path.basename(r.file) for r in lines.select("file").distinct().collect()))
        return A.read(lines, b"k").events

    def run(version="1"):
        plan = {os.path.basename(r.path): r.action for r in N.refresh_rows(spark, str(root), store, version, parse, 4).collect()}
        whole = A.read(spark.read.text(str(root)).select(F.lit("f").alias("file"), F.monotonically_increasing_id().alias("ordinal"), "value"), b"k").events
        told = lambda df: sorted(map(str, map(tuple, df.select("session_id", "event_type", "ts_ms", "provider_event_id").collect())))
        assert told(spark.read.parquet(f"{store}/rows")) == told(whole)
        return plan

    assert set(run().values()) == {"read"} and len(reads) == 1
    before = parts(f"{store}/rows")
    assert set(run().values()) == {"skip"} and len(reads) == 1 and parts(f"{store}/rows") == before
    write(root / "1.jsonl", [line("s1", n) for n in range(5)])  # grown
    write(root / "9.jsonl", [line("s9", n) for n in range(2)])  # new
    plan = run()
    assert (plan["1.jsonl"], plan["9.jsonl"], plan["2.jsonl"]) == ("tail", "read", "skip") and reads[1] == ["1.jsonl", "9.jsonl"]
    after = parts(f"{store}/rows")
    kept = [k for k in before if after.get(k) == before[k]]
    assert 0 < len(kept) < 4
    (root / "3.jsonl").unlink()  # gone
    write(root / "2.jsonl", [line("s2", 0)])  # shorter
    same = (root / "4.jsonl").stat()
    write(root / "4.jsonl", [line("t4", n) for n in range(3)])  # other lines of the same size
    os.utime(root / "4.jsonl", (same.st_atime, same.st_mtime + 60))
    plan = run()
    assert [plan[f"{k}.jsonl"] for k in (2, 3, 4)] == ["reset", "gone", "reset"] and reads[2] == ["2.jsonl", "4.jsonl"]
    assert set(run("2").values()) == {"reset"}  # another parser version reads everything
    for f in root.iterdir():
        f.unlink()
    write(root / "0.jsonl", [line("s0", 0)])
    run("2")


@pytest.fixture(scope="module")
def frames(spark):
    def build(edits, shas):
        subjects = spark.createDataFrame([(f"p{r}{k}", r, "f", 1000 * k, False) for r, k in edits], "patch_id string, repo_id string, rel_path string, edit_ms long, ignored boolean")
        lines = spark.createDataFrame([(f"p{r}{k}", r, "f", f"x{k}", 0, 1000 * k) for r, k in edits], "patch_id string, repo_id string, rel_path string, fp string, ordinal int, edit_ms long")
        hits = spark.createDataFrame([(r, "f", "x1", sha, 10**9, True) for r, sha in shas.items()], "repo_id string, rel_path string, fp string, sha string, commit_ms long, on_default boolean")
        refs = spark.createDataFrame([(r, "HEAD", sha) for r, sha in shas.items()], "repo_id string, ref string, sha string")
        tree = spark.createDataFrame([("a", "f", "x2", "worktree")], "repo_id string, rel_path string, fp string, kind string")
        files = spark.createDataFrame([(r, "f", 1, 1) for r in shas], "repo_id string, rel_path string, size int, mtime_ms int")
        return subjects, lines, hits, tree, refs, files

    return build


def test_one_changed_repository_rewrites_one_partition(spark, tmp_path, frames):
    store = str(tmp_path / "store")
    edits, shas = [(r, k) for r in ("a", "b/x", "c") for k in range(4)], {"a": "1", "b/x": "1", "c": "1"}

    def run(edits, shas, config="1"):
        subjects, lines, hits, tree, refs, files = frames(edits, shas)
        done = N.refresh_outcomes(spark, store, subjects, lines, hits, tree, refs, files, ["patch_id"], config)
        want = M.classify(subjects, lines, hits, tree, ["patch_id"])
        got = spark.read.parquet(f"{store}/outcomes").select(*want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        return sorted(r.repo_id for r in done.collect()), parts(f"{store}/outcomes")

    done, first = run(edits, shas)
    assert done == ["a", "b/x", "c"] and len(first) == 3
    assert run(edits, shas) == ([], first)
    done, second = run([*edits, ("b/x", 9)], shas)
    assert done == ["b/x"] and [k for k in first if second[k] != first[k]] == ["repo_id=b%2Fx"]
    done, third = run([*edits, ("b/x", 9)], {**shas, "c": "2"})
    assert done == ["c"] and [k for k in second if third[k] != second[k]] == ["repo_id=c"]
    done, fourth = run([e for e in edits if e[0] != "a"], {**shas, "c": "2"})
    assert done == ["b/x"] and "repo_id=a" not in fourth
    assert run([e for e in edits if e[0] != "a"], {**shas, "c": "2"}, config="2")[0] == ["b/x", "c"]


def test_versions_are_dropped_after_their_time(spark, tmp_path):
    path = str(tmp_path / "t")
    assert Y.current(spark, path, "k long").count() == 0
    for n in range(3):
        Y.replace_all(spark.createDataFrame([(n,)], "k long"), ["k"], path)
    now = int(__import__("time").time() * 1000)
    assert Y.drop_versions(spark, path, 3_600_000, now) == 0
    assert Y.drop_versions(spark, path, -1000, now) == 2
    assert [r.k for r in Y.current(spark, path).collect()] == [2]


def test_counters_need_no_scan_of_their_own(spark, tmp_path):
    rows, seen = I.counted(spark.range(1000), rows=F.count(F.lit(1)), odd=F.count_if(F.col("id") % 2 == 1))
    rows.write.parquet(str(tmp_path / "out"))
    assert {r.name: r.n for r in I.scan_report(spark, [seen]).collect()} == {"rows": 1000, "odd": 500}


def test_kept_rows_are_counted_by_name(spark):
    sessions = spark.createDataFrame([("a", None, 5), ("b", 1, 9), ("c", None, None)], "session_id string, ended_ms long, last_ms long")
    patches = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "session_id string")
    kept = I.prune(sessions, {"patches": patches, "none": patches.where("false")}, 5)
    assert {r.name: r.n for r in I.row_counts(kept).collect()} == {"sessions": 2, "patches": 3, "none": 0}


def test_outcomes_are_sorted_behind_their_shuffle(spark):
    """A task sorts its share of the keys, not all that it reads."""
    names = "scope string, patch_id string, session_id string, repo_id string, rel_path string, class string, computed_ms long"
    row = lambda path, kind, ms: ("session-file", None, "s", "r", path, kind, ms)
    stored = spark.createDataFrame([row("a", "landed", 1), row("b", "landed", 3), row("c", "lost", 2)], names)
    computed = spark.createDataFrame([row("a", "lost", 2), row("b", "lost", 2), row("c", "landed", 2), row("d", "lost", 1)], names)
    latest = I.upsert_outcomes(stored, computed)
    assert {r.rel_path: r["class"] for r in latest.collect()} == {"a": "lost", "b": "landed", "c": "landed", "d": "lost"}
    plan = latest._jdf.queryExecution().sparkPlan().toString() + latest._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.rindex("AdaptiveSparkPlan"):]
    assert 0 < plan.index("partial_max_by") < plan.index("Exchange")


def test_stream_counters(spark, tmp_path):
    listener = I.StreamCounters()
    spark.streams.addListener(listener)
    try:
        for n in range(2):
            spark.range(n * 10, n * 10 + 10).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("id long").option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
        counted = source.observe("scan", F.count(F.lit(1)).alias("rows"), F.sum("id").alias("ids"))
        counted.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):
            if listener.totals.get("rows") == 20:
                break
            __import__("time").sleep(0.1)
        assert listener.totals == {"rows": 20, "ids": sum(range(20))}
    finally:
        spark.streams.removeListener(listener)

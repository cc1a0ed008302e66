"""Streaming runs over files, ended by available-now triggers."""

import json

from pyspark.sql import functions as F

from worklake.sources import dialect_a as A
from worklake.streaming import live as L

NOW = {"availableNow": True}


def write(path, lines):
    path.write_text("\n".join(json.dumps(x) for x in lines) + "\n")


def entry(session, n, kind="user", **more):
    return {"type": kind, "sessionId": session, "uuid": f"{session}-{n}", "timestamp": f"2025-01-01T00:{n:02d}:00Z", "message": {"content": "hi"}, **more}


def test_import_is_idempotent_and_refreshes_status(spark, tmp_path):
    root, table, check = tmp_path / "in", str(tmp_path / "events"), str(tmp_path / "check")
    root.mkdir()
    ask = {"id": "m", "content": [{"type": "tool_use", "id": "q", "name": "AskUserQuestion"}]}
    write(root / "one.jsonl", [entry("s1", 0), entry("s1", 1, "assistant", message=ask)])
    seen = []

    def after(touched):
        rows = L.refresh_status(spark.read.parquet(table), touched)
        seen.append({r["session_id"]: r["status"] for r in rows.collect()})

    def run():
        normalize = lambda lines: A.read(lines, b"k").events
        q = L.import_stream(spark, str(root), normalize, table, check, after, NOW)
        q.awaitTermination()

    run()
    first = spark.read.parquet(table).count()
    # The next chunk repeats the old lines and brings the answer.
    done = [{"type": "tool_result", "tool_use_id": "q", "content": "ok"}]
    end = {"id": "m2", "content": [], "stop_reason": "end_turn"}
    write(
        root / "two.jsonl",
        [entry("s1", 0), entry("s1", 2, message={"content": done}), entry("s1", 3, "assistant", message=end), entry("s2", 4)],
    )
    run()
    assert (first, spark.read.parquet(table).count()) == (3, 6)
    assert seen == [{"s1": "awaiting-user"}, {"s1": "completed", "s2": "unknown"}]


def test_notices_are_raised_once(spark, tmp_path):
    path = str(tmp_path / "raised")
    sessions = spark.createDataFrame(
        [("a", "awaiting-user", None, 100, None, "T", "r"), ("b", "completed", None, 100, None, None, None)],
        "session_id string, status string, ended_ms long, last_ms long, x string, title string, repo_id string",
    )
    waiting = L.awaiting_notices(sessions, 200)
    assert [r["silent"] for r in L.raise_notices(waiting, path, silent=True).collect()] == [True]
    assert L.raise_notices(waiting, path).count() == 0
    moved = L.awaiting_notices(sessions.withColumn("last_ms", F.lit(150).cast("long")), 200)
    assert [r["notice_key"] for r in L.raise_notices(moved, path).collect()] == ["awaiting-user:a:150"]
    assert L.raise_notices(moved, path).count() == 0


def test_a_retried_batch_raises_the_same_notices(spark, tmp_path):
    path = str(tmp_path / "raised")
    rows = spark.createDataFrame([("k", n, "s", "f", "m") for n in ("a", "b")], "kind string, notice_key string, session_id string, rel_path string, message string")
    keys = lambda run, df: sorted(r["notice_key"] for r in L.raise_notices(df, path, run=run).collect())
    assert keys("1", rows.where("notice_key = 'a'")) == ["a"]
    assert keys("2", rows) == ["b"] == keys("2", rows)
    assert keys("3", rows) == [] and spark.read.parquet(path).count() == 2


def test_import_of_rollouts_with_a_fork(spark, tmp_path):
    """Two files in one micro-batch: both headers count, and copied history is left out."""
    from test_sources import SID, item, roll

    from worklake.sources import dialect_b as B
    from worklake.sources import files as S

    root, table = tmp_path / "in", str(tmp_path / "events")
    root.mkdir()
    child = SID.replace("0a0b", "1a1b")
    search = lambda n, at=None: {**roll(n, "event_msg", item(type="WebSearch", id=f"w{n}")), **({"timestamp": at} if at else {})}
    burst = "2025-03-01T10:00:00.100Z"
    meta = {"timestamp": "2025-03-01T10:00:00Z", "cwd": "/w", "git": {"branch": "dev"}}
    write_compact = lambda p, rows: p.write_text("\n".join(json.dumps(x, separators=(",", ":")) for x in rows) + "\n")
    write_compact(root / f"rollout-2025-03-01T10-00-00-{SID}.jsonl", [roll(0, "session_meta", {"id": SID, **meta}), search(1), search(2)])
    write_compact(
        root / f"rollout-2025-03-01T10-00-01-{child}.jsonl",
        [roll(0, "session_meta", {"id": child, **meta, "forked_from_id": SID, "subagent_history_start_ordinal": 3}), search(1, burst), search(2, burst), search(5)],
    )
    normalize = lambda lines: B.read(S.rollout_order(lines), b"k").events
    for _ in range(2):
        L.import_stream(spark, str(root), normalize, table, str(tmp_path / "check"), None, NOW).awaitTermination()
    rows = spark.read.parquet(table).collect()
    own = lambda sid: sorted(r["event_type"] for r in rows if r["session_id"] == sid)
    assert own(SID).count("session.started") == own(child).count("session.started") == 1
    assert (len(own(SID)), len(own(child))) == (3, 2) and {r["cwd"] for r in rows} == {"/w"}


def stream_of(spark, df, folder):
    df.coalesce(1).write.parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


def run_to_table(stream, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option(
        "checkpointLocation", str(tmp_path / name)
    ).trigger(**NOW).start()
    q.awaitTermination()


def test_activity_windows_equal_batch(spark, tmp_path):
    from worklake.bindings import Domain

    events = Domain(spark, "/root/testdata/sf0.001").log_events.select("session_id", "ts_ms")
    batch = {tuple(r) for r in L.activity_windows(events, ["session_id"], 600_000).collect()}
    live = stream_of(spark, events, str(tmp_path / "ev"))
    run_to_table(L.activity_windows(live, ["session_id"], 600_000), "spans", tmp_path)
    closed = {tuple(r) for r in spark.table("spans").collect()}
    # The last stretches stay open until the watermark passes them.
    assert closed <= batch and len(batch) - len(closed) < 10 and closed


def test_signals_are_deduplicated(spark, tmp_path):
    cols = "provider string, provider_event_type string, session_id string, event_type string, ts_ms long"
    a = spark.createDataFrame([("p", "x", "s", "e", 1_000), ("p", "x", "s", "e", 2_000)], cols)
    b = spark.createDataFrame([("p", "x", "s", "e", 2_000), ("p", "hook", "s", "e", 2_000)], cols)
    merged = L.merge_signals(stream_of(spark, a, str(tmp_path / "a")), stream_of(spark, b, str(tmp_path / "b")))
    run_to_table(merged, "signals", tmp_path)
    assert sorted((r["provider_event_type"], r["ts_ms"]) for r in spark.table("signals").collect()) == [
        ("hook", 2_000), ("x", 1_000), ("x", 2_000)
    ]

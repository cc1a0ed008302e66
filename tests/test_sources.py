"""Readers on files written by the tests."""

import json

import pytest
from pyspark.sql import functions as F

from worklake.sources import dialect_a as A
from worklake.sources import dialect_b as B
from worklake.sources import files as S
from worklake.sources import gitlog as G
from worklake.sources import hooks as H

KEY = b"test"
T0 = "2025-03-01T10:00:0"


def line(kind, n, **more):
    return {"type": kind, "sessionId": "s1", "uuid": f"u{n}", "timestamp": f"{T0}{n}.500Z", "cwd": "/w", "gitBranch": "main", **more}


def call(id, name, **args):
    return {"type": "tool_use", "id": id, "name": name, "input": args}


def result(id, content="", error=False):
    return {"type": "tool_result", "tool_use_id": id, "content": content, "is_error": error}


TRANSCRIPT = [
    line("user", 0, message={"content": "SENTINEL_PROMPT do it"}),
    line("assistant", 1, message={"id": "m1", "model": "x-1", "content": [{"type": "text", "text": "SENTINEL_ANSWER"}, call("c1", "Bash", command="API_TOKEN=q make all\nSENTINEL_SECOND")], "usage": {"input_tokens": 3, "cache_creation_input_tokens": 4, "output_tokens": 5, "cache_read_input_tokens": 6}}),
    line("assistant", 1, uuid="u1b", message={"id": "m1", "model": "x-1", "content": [], "usage": {"input_tokens": 3, "cache_creation_input_tokens": 4, "output_tokens": 9}, "stop_reason": "end_turn"}),
    line("user", 2, message={"content": [result("c1", "SENTINEL_OUT", True)]}, toolUseResult={"stdout": "SENTINEL_STD"}),
    line("assistant", 3, message={"id": "m2", "model": "<synthetic>", "content": [call("c2", "Write", file_path="/w/a.ts"), call("c3", "AskUserQuestion"), call("c4", "Task")], "usage": {"input_tokens": 99}}),
    line("user", 4, message={"content": [result("c2")]}, toolUseResult={"filePath": "/w/a.ts", "type": "create", "content": "first real line\nsecond real line\n}\n", "structuredPatch": []}),
    line("user", 5, message={"content": [result("c9")]}, toolUseResult={"filePath": "/w/b.ts", "structuredPatch": [{"lines": ["-old long line here", "+  old long   line here", "+a brand new line", " context"]}]}),
    line("user", 6, message={"content": [result("c4", [{"type": "text", "text": "[Request interrupted by user]"}])]}),
    line("user", 7, message={"content": [result("c3")]}, toolDenialKind="reject"),
    line("assistant", 8, isApiErrorMessage=True, apiErrorStatus="429", message={}),
    line("user", 8, isMeta=True, message={"content": "SENTINEL_META"}),
    line("user", 9, interruptedByShutdown=True, message={}),
    {"type": "custom-title", "sessionId": "s1", "customTitle": "My title"},
    {"type": "ai-title", "sessionId": "s1", "aiTitle": "Other"},
    {"type": "cost-state", "sessionId": "s1", "totalCostUSD": 1.25},
]


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("a")
    (root / "p").mkdir()
    text = "\n".join(json.dumps(x) for x in TRANSCRIPT) + "\nnot json\n"
    (root / "p" / "s1.jsonl").write_text(text)
    return A.read(S.read_lines(spark, str(root)), KEY)


def test_events_in_order(logs):
    got = [r["event_type"] for r in logs.events.orderBy("ordinal", "seq").collect()]
    assert got == [
        "prompt.submitted", "command.started", "turn.completed", "command.failed", "tool.started",
        "tool.started", "session.awaiting-user", "subagent.started", "tool.completed", "edit.applied",
        "tool.completed", "edit.applied", "agent.interrupted", "approval.resolved", "error", "agent.interrupted",
    ]


def test_event_details(logs):
    rows = {(r["event_type"], r["call_id"]): r for r in logs.events.collect()}
    failed = rows["command.failed", "c1"]
    assert (failed["executable"], failed["display"], failed["redactions"]) == ("make", "API_TOKEN=[REDACTED] make all", 1)
    assert rows["tool.completed", "c9"]["tool_name"] == "unknown" and rows["tool.completed", "c9"]["file_path"] == "/w/b.ts"
    assert rows["error", None]["error_code"] == "429"
    assert rows["turn.completed", None]["provider_event_id"] == "m1"


def test_patches(logs):
    rows = {r["path"]: r for r in logs.patches.collect()}
    assert (rows["/w/a.ts"]["operation"], len(rows["/w/a.ts"]["added_fps"]), rows["/w/a.ts"]["added_raw"]) == ("create", 2, 3)
    b = rows["/w/b.ts"]
    assert (len(b["added_fps"]), len(b["removed_fps"]), b["added_raw"], b["removed_raw"]) == (1, 1, 2, 1)


def test_usage_facts_failures(logs):
    from worklake.operators.usage import merge_usage

    u = merge_usage(logs.usage).collect()
    assert [(r["usage_key"], r["input_tokens"], r["output_tokens"], r["cached_tokens"]) for r in u] == [("m1", 7, 9, 6)]
    s = logs.sessions.first()
    assert (s["title"], s["title_provenance"], s["cost_usd"], s["model"], s["cwd"]) == ("My title", "observed", 1.25, "x-1", "/w")
    assert [r["reason"] for r in logs.failures.collect()] == ["invalid-json"]


def test_no_text_leaves_the_reader(logs):
    for frame in (logs.events, logs.patches, logs.usage, logs.sessions):
        assert not any("SENTINEL" in r["j"] for r in frame.select(F.to_json(F.struct("*")).alias("j")).collect())


SID = "0a0b0c0d-1111-4222-8333-444455556666"


def roll(n, kind, payload, ordinal=None):
    return {"timestamp": f"2025-03-01T10:00:{n:02d}Z", "ordinal": n if ordinal is None else ordinal, "type": kind, "payload": payload}


def item(**body):
    return {"type": "item_completed", "item": body}


ROLLOUT = [
    roll(0, "session_meta", {"id": SID, "timestamp": "2025-03-01T10:00:00Z", "cwd": "/w", "git": {"branch": "dev"}, "source": {"subagent": {"thread_spawn": {"parent_thread_id": "parent"}}}}),
    roll(1, "event_msg", item(type="FileChange", id="f0", status="completed", changes={"x.ts": {"type": "add", "content": "alpha beta gamma\n"}, "/abs.ts": {"type": "delete"}, "old.ts": {"type": "update", "move_path": "new.ts", "unified_diff": "@@ -1 +1 @@\n-was like this once\n+is like that now\n"}})),
    roll(2, "turn_context", {"cwd": "/other", "model": "m-2"}),
    roll(3, "event_msg", item(type="FileChange", id="f1", status="completed", changes={"y.ts": {"type": "update", "unified_diff": "@@\n+one more good line\n"}})),
    roll(4, "response_item", {"text": "SENTINEL"}),
    roll(5, "event_msg", item(type="DynamicToolCall", id="d", tool="t", status="completed", success=False)),
    roll(6, "event_msg", item(type="SubAgentActivity", id="g", kind="started")),
    roll(7, "event_msg", {"type": "task_complete", "turn_id": "t1", "error": {"code": 1}}),
    roll(8, "event_msg", {"type": "task_complete", "turn_id": "t2", "error": None}),
    roll(9, "session_meta", {"id": "someone-else"}),
    roll(10, "event_msg", item(type="Reasoning", id="r")),
]


def test_rollout(spark, tmp_path):
    (tmp_path / f"rollout-2025-03-01T10-00-00-{SID}.jsonl").write_text("\n".join(json.dumps(x, separators=(",", ":")) for x in ROLLOUT))
    logs = B.read(S.rollout_order(S.read_lines(spark, str(tmp_path))), KEY)
    ev = logs.events.orderBy("ordinal", "seq").collect()
    assert [e["event_type"] for e in ev] == [
        "session.started", "edit.applied", "edit.applied", "edit.applied", "edit.applied", "tool.failed",
        "subagent.started", "error", "turn.completed",
    ]
    assert {e["session_id"] for e in ev} == {SID} and {e["parent_session_id"] for e in ev} == {"parent"}
    assert [e["cwd"] for e in ev if e["event_type"] == "tool.failed"] == ["/other"]
    patches = {r["path"]: (r["operation"], len(r["added_fps"]), len(r["removed_fps"])) for r in logs.patches.collect()}
    assert patches == {"/w/x.ts": ("create", 1, 0), "/w/new.ts": ("rename", 1, 1), "/other/y.ts": ("modify", 1, 0)}
    s = logs.sessions.first()
    assert (s["branch_first"], s["model"], s["parent_session_id"]) == ("dev", "m-2", "parent")


def test_only_a_first_line_is_a_header(spark, tmp_path):
    """Two rollouts in one task: the second one opens with another line, so its header does not count."""
    other = SID.replace("0a0b", "1a1b")
    for n, (sid, rows) in enumerate(((SID, ROLLOUT[:3]), (other, [ROLLOUT[2], ROLLOUT[0]]))):
        (tmp_path / f"rollout-2025-03-0{n + 1}T10-00-00-{sid}.jsonl").write_text("\n".join(json.dumps(x, separators=(",", ":")) for x in rows))
    lines = S.rollout_order(S.read_lines(spark, str(tmp_path)).coalesce(1))
    assert [(r["session_id"], r["head_cwd"]) for r in B.headers(B.triage(lines), lines).collect()] == [(SID, "/w")]


def test_line_numbers_across_blocks(spark, tmp_path):
    """Small splits, of two files: ordinals rise along each file, line numbers are dense."""
    n = 5000
    (tmp_path / "small.jsonl").write_text('{"n":0}\n\n{"n":2}\n')
    (tmp_path / "big.jsonl").write_text("\n".join(f'{{"n":{i}}}' for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = S.read_lines(spark, str(tmp_path))
        plan = lines._jdf.queryExecution().executedPlan().toString()
        rows = S.line_numbers(lines, lines).select("file", "ordinal", "line_no", F.get_json_object("value", "$.n").cast("int").alias("n")).collect()
        firsts = {(r["file"], r["ordinal"]) for r in S.first_lines(lines).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert "Exchange" not in plan
    big = [r for r in rows if r["file"].endswith("big.jsonl")]
    small = [r for r in rows if r["file"].endswith("small.jsonl")]
    assert sorted(r["line_no"] for r in big) == list(range(n)) and all(r["line_no"] == r["n"] for r in big)
    assert [r["n"] for r in sorted(big, key=lambda r: r["ordinal"])] == list(range(n))
    assert sorted((r["line_no"], r["n"]) for r in small if r["n"] is not None) == [(0, 0), (2, 2)] and len(small) == 3
    assert firsts == {(r["file"], r["ordinal"]) for r in rows if r["line_no"] == 0}


def test_git_log_and_snapshots(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "r.txt").write_text(
        "\u0001aaa\u0002100\u0002fix token=abc\n\ndiff --git a/x.ts b/x.ts\n--- a/x.ts\n+++ b/x.ts\n@@ -0,0 +1,2 @@\n+++counter for all\n+another good line\n"
        "\u0001bbb\u0002200\u0002second\n\ndiff --git a/y.ts b/y.ts\n--- a/y.ts\n+++ /dev/null\n@@ -1 +0,0 @@\n-gone gone gone\n"
    )
    commits = G.parse_commits(G.read_patch_log(spark, str(log)).withColumn("repo_id", F.lit("r")))
    assert {(r["sha"], r["commit_ms"], r["subject"]) for r in commits.collect()} == {("aaa", 100_000, "fix token=[REDACTED]"), ("bbb", 200_000, "second")}
    touched = spark.createDataFrame([("r", "x.ts"), ("r", "y.ts")], "repo_id string, rel_path string")
    assert G.added_lines(commits, touched, KEY).count() == 2
    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "a.txt").write_text("some content here\r\nsome content here\n")
    (tree / "bin").write_bytes(b"text then \0 zero")
    (tree / "big").write_bytes(b"x" * (5 * 1024 * 1024 + 1))
    snaps = G.read_snapshots(spark, str(tree))
    assert [r["file"].rsplit("/", 1)[1] for r in snaps.collect()] == ["big", "a.txt"]
    assert [(r["file"].rsplit("/", 1)[1], r["reason"]) for r in G.skipped_snapshots(spark, str(tree)).collect()] == [("bin", "binary")]
    named = snaps.select(F.lit("r").alias("repo_id"), F.lit("a.txt").alias("rel_path"), F.lit("head").alias("kind"), "content")
    assert G.snapshot_lines(named, KEY).count() == 2


def test_hooks(spark):
    data = [
        {"session_id": "s", "hook_event_name": "PermissionRequest", "tool_use_id": "c", "agent_id": "a"},
        {"session_id": "s", "hook_event_name": "SessionEnd", "reason": "exit"},
        {"session_id": "s", "hook_event_name": "Stop"},
        {"hook_event_name": "Stop"},
    ]
    df = spark.createDataFrame([(json.dumps(x), 5) for x in data], "value string, received_ms long")
    rows = {r["provider_event_type"]: r for r in H.normalize_hooks(df, "claude-code").collect()}
    assert set(rows) == {"hook:PermissionRequest", "hook:SessionEnd:exit", "hook:Stop"}
    assert (rows["hook:PermissionRequest"]["session_id"], rows["hook:PermissionRequest"]["tool_name"]) == ("s:a", "unknown")
    assert rows["hook:Stop"]["event_type"] is None

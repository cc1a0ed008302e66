"""A whole scan of small logs and histories: what each stage gives on the rows of the stage before."""

import json

import pytest
from pyspark.sql import functions as F

from worklake.functions.text import line_fingerprint
from worklake.operators import history as G
from worklake.operators import matching as M
from worklake.plans import scan as P
from worklake.sources import dialect_a as A
from worklake.sources import dialect_b as B
from worklake.sources import files as L

KEY = b"k"
HOUR, DAY = 3_600_000, 86_400_000
START = 1_735_689_600_000  # 2025-01-01


def at(hours):
    import datetime

    return (datetime.datetime(2025, 1, 1) + datetime.timedelta(hours=hours)).strftime("%Y-%m-%dT%H:%M:%SZ")


def edit(sid, hour, call, path, added, removed=()):
    """A tool use and its result with one hunk."""
    body = {"sessionId": sid, "cwd": "/w/one", "gitBranch": "feat/x"}
    use = {**body, "type": "assistant", "uuid": f"{call}-u", "timestamp": at(hour), "message": {"id": f"m{call}", "content": [{"type": "tool_use", "id": call, "name": "Edit"}]}}
    hunk = {"lines": [*[f"-{x}" for x in removed], *[f"+{x}" for x in added]]}
    result = {**body, "type": "user", "uuid": f"{call}-r", "timestamp": at(hour), "message": {"content": [{"type": "tool_result", "tool_use_id": call, "content": "ok"}]}, "toolUseResult": {"filePath": path, "structuredPatch": [hunk]}}
    return [use, result]


def text(n, what="line"):
    return [f"this is {what} number {k}" for k in range(n)]


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    (root / "a").mkdir()
    one = edit("s1", 0, "c1", "/w/one/src/a.py", text(30)) + edit("s1", 1, "c2", "/w/one/src/b.py", text(25, "open"))
    two = edit("s2", 1.5, "c3", "/w/one/src/b.py", text(3, "other"), text(20, "open")) + edit("s2", 2, "c4", "/w/one/src/c.py", text(40, "lost"))
    copied = [{**x, "sessionId": "s3"} for x in one] + edit("s3", 3, "c5", "/elsewhere/x.py", text(9))
    for name, rows in (("s1", one), ("s2", two), ("s3", copied)):
        (root / "a" / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
    fp = lambda xs: spark.createDataFrame([(x,) for x in xs], "t string").select(line_fingerprint(F.col("t"), KEY).alias("fp"))
    row = lambda df, path, **c: df.select(F.lit("r1").alias("repo_id"), F.lit(path).alias("rel_path"), "fp", *[F.lit(v).alias(k) for k, v in c.items()])
    lines = row(fp(text(30)), "src/a.py", sha="1" * 40, commit_ms=START + 5 * HOUR)
    tree = row(fp(text(25, "open")), "src/b.py", kind="worktree").unionByName(row(fp(text(30)), "src/a.py", kind="head"))
    commits = spark.createDataFrame([("r1", "0" * 40, START - DAY, "begin", None), ("r1", "1" * 40, START + 5 * HOUR, "add a", None)], "repo_id string, sha string, commit_ms long, subject string, body string")
    parents = spark.createDataFrame([("r1", "1" * 40, "0" * 40, 0)], "repo_id string, sha string, parent_sha string, parent_no int")
    refs = spark.createDataFrame([("r1", "refs/heads/main", "1" * 40, None)], "repo_id string, ref string, sha string, target string")
    repos = spark.createDataFrame([("r1", "/w/one")], "repo_id string, root_path string")
    logs = lambda: [A.read(L.read_lines(spark, str(root / "a")), KEY), B.read(L.rollout_order(L.read_lines(spark, str(root / "a"))), KEY)]
    return logs, repos, P.History(commits, parents, refs, lines, tree)


def test_a_scan_and_its_repeat(spark, tmp_path, world):
    logs, repos, history = world
    run = lambda: P.scan(logs(), ["claude-code", "codex"], repos, history, str(tmp_path / "store"), START + 10 * DAY)
    first = run()
    report = {r.name: r.n for r in first.report.collect()}
    assert report["edits_read"] == report["edits_inserted"] == 5  # copies of s1 in s3 belong to s1
    sessions = {r.session_id: r for r in first.sessions.collect()}
    assert set(sessions) == {"s1", "s2", "s3"} and {s.repo_id for s in sessions.values()} == {"r1"}
    assert sessions["s1"].started_ms == START and sessions["s1"].git_branch_start == "feat/x" and sessions["s1"].changed_files == 2
    outcomes = {(r.session_id, r.rel_path): r for r in first.outcomes.collect()}
    assert {k: r["class"] for k, r in outcomes.items()} == {
        ("s1", "src/a.py"): "landed", ("s1", "src/b.py"): "uncommitted", ("s2", "src/b.py"): "lost", ("s2", "src/c.py"): "lost"
    }
    a = outcomes["s1", "src/a.py"]
    assert (a.first_sha, a.first_subject, a.first_branch, a.survival, a.commit_lag_seconds) == ("1" * 40, "add a", "main", "surviving", 5 * 3600)
    members = {r.session_id: r.thread_id for r in first.members.collect()}
    assert members == {"s1": "s1", "s2": "s1", "s3": "s1"}  # one work branch
    loops = {(r.type, r.lines) for r in first.loops.collect()}
    assert ("uncommitted-output", 25) in loops
    met = [tuple(r) for r in first.collisions.select("kind", "rel_path", "session_a", "session_b", "overwritten_lines").collect()]
    assert met == [("overwrite", "src/b.py", "s1", "s2", 20)]
    assert first.insights.count() == 0
    # The outcomes are those of the stage called by hand on what the scan has stored.
    inside = first.patches.where("rel_path is not null")
    subjects = M.session_file_subjects(inside).withColumn("ignored", F.lit(False))
    lines = M.net_session_file(first.patch_lines.where("rel_path is not null")).join(subjects.select(*P.FILE_KEY, "edit_ms"), P.FILE_KEY)
    on = G.on_default(history.refs, history.parents).withColumn("on_default", F.lit(True))
    want = M.classify(subjects, lines, history.lines.join(on, ["repo_id", "sha"], "left"), history.snapshots, P.FILE_KEY)
    both = [sorted(map(str, df.select(*P.FILE_KEY, "class", "line_count", "frac_committed", "first_sha").collect())) for df in (first.outcomes, want)]
    assert both[0] == both[1] and len(both[0]) == 4
    again = run()
    report = {r.name: r.n for r in again.report.collect()}
    assert report["edits_inserted"] == report["events_inserted"] == 0 and report["events_read"] > 0
    told = lambda df, *drop: sorted(map(str, df.drop(*drop).collect()))
    for name in ("events", "patches", "sessions", "outcomes", "threads", "members", "loops", "collisions"):
        assert told(getattr(first, name)) == told(getattr(again, name)), name

"""One scan from end to end: logs and history in, everything that is derived from them out.

Each stage reads what the one before has written. Events and patches are stored under keys, so a second
scan of the same logs inserts nothing and derives the same rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklake.config import DAY, InsightRules, LoopRules, ThreadRules
from worklake.functions.text import patch_key
from worklake.operators import collisions as C
from worklake.operators import detect as D
from worklake.operators import history as G
from worklake.operators import ingest as I
from worklake.operators import matching as M
from worklake.operators import sessions as S
from worklake.operators import threads as T
from worklake.operators.incremental import exists
from worklake.operators.ordered import join_known, materialize
from worklake.operators.usage import merge_usage
from worklake.sources.dialect_a import Logs
from worklake.streaming.live import fingerprints

FILE_KEY = ["session_id", "repo_id", "rel_path"]
ORDER = ["rank", "file", "ordinal", "place"]


@dataclass(frozen=True)
class History:
    """Exported history of the repositories.

    `commits` (repo_id, sha, commit_ms, subject, body), `parents` (repo_id, sha, parent_sha, parent_no),
    `refs` (repo_id, ref, sha, target), `lines` added by commits (repo_id, rel_path, fp, sha, commit_ms)
    and `snapshots` (repo_id, rel_path, fp, kind).
    """

    commits: DataFrame
    parents: DataFrame
    refs: DataFrame
    lines: DataFrame
    snapshots: DataFrame


@dataclass(frozen=True)
class Scan:
    """Everything a scan derives; `report` has name and n of what it read and inserted."""

    events: DataFrame
    patches: DataFrame
    patch_lines: DataFrame
    sessions: DataFrame
    outcomes: DataFrame
    threads: DataFrame
    members: DataFrame
    evidence: DataFrame
    loops: DataFrame
    collisions: DataFrame
    insights: DataFrame
    report: DataFrame


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _in_file_order(rows: DataFrame, place: str) -> DataFrame:
    """Columns of ORDER: main logs come before those of sub-agents, live ones before archived ones."""
    late = F.col("file").contains("/subagents/") | F.col("file").contains("/archived_sessions/")
    return rows.withColumn("rank", late.cast("int")).withColumn("place", F.col(place).cast("long"))


def _store(rows: DataFrame, path: str, key: list[str]) -> tuple[DataFrame, list]:
    """All stored rows after those of `rows` that are new were added; counters of both."""
    spark = rows.sparkSession
    name = path.rsplit("/", 1)[1]
    rows, read = I.counted(rows, **{f"{name}_read": F.count(F.lit(1))})
    rows = materialize(rows, name)
    known = spark.read.schema(rows.schema).parquet(path) if exists(spark, path) else rows.where("false")
    fresh, new = I.counted(I.insert_new(rows, known, key, ORDER), **{f"{name}_inserted": F.count(F.lit(1))})
    fresh.write.parquet(f"{path}/scan={uuid.uuid4().hex}")
    return spark.read.schema(rows.schema).parquet(path), [read, new]


def _sessions(logs: list[Logs], events: DataFrame, patches: DataFrame, usage: DataFrame, repos: DataFrame, providers: list[str]) -> DataFrame:
    facts = _union([
        one.sessions.withColumn("provider", F.lit(p)).withColumn("pass_no", F.lit(k)) for k, (one, p) in enumerate(zip(logs, providers, strict=True))
    ])
    for c in ("title", "title_provenance"):
        facts = facts if c in facts.columns else facts.withColumn(c, F.lit(None).cast("string"))
    merged = S.merge_sessions(facts).withColumnsRenamed({"first_ms": "fact_first", "last_ms": "fact_last"})
    inside = F.concat("cwd", F.lit("/."))  # a folder may be the repository's own
    fresh = S.refresh_sessions(merged, events, patches, usage).withColumn("inside", inside)
    placed = I.resolve_repos(fresh.where("cwd is not null"), repos, "inside").withColumnRenamed("root_path", "repo_root")
    return join_known(fresh, placed, ["inside"]).drop("inside").select(
        "*",
        F.coalesce("first_ms", "fact_first").alias("started_ms"),  # own events, not copied ones
        F.coalesce("last_ms", "fact_last").alias("at_ms"),
        F.col("branch_start").alias("git_branch_start"),
        F.coalesce("branch_end", "branch_start").alias("git_branch_end"),
    ).drop("fact_first", "fact_last", "first_ms", "last_ms", "branch_start", "branch_end").withColumnRenamed("at_ms", "last_ms")


def _patch_lines(patches: DataFrame) -> DataFrame:
    side = lambda name: patches.select(
        "patch_id", "session_id", "repo_id", "rel_path", "ts_ms", F.lit(name).alias("side"),
        F.posexplode(f"{name}_fps").alias("ordinal", "fp"),
    )
    return side("added").unionByName(side("removed"))


def judge_files(patches: DataFrame, patch_lines: DataFrame, history: History, now_ms: int, margin_ms: int = DAY) -> DataFrame:
    """Outcome of each file of each session, with the first commit's subject and branch."""
    index = G.history_index(history.parents)
    default = materialize(G.on_default(history.refs, history.parents, index), "on-default")
    branches = G.branch_of(history.refs, history.parents, default, index)
    main = G.default_branch(history.refs).select("repo_id", F.col("default_branch").alias("main"))
    on = default.withColumn("on_default", F.lit(True))
    commits = (
        history.commits.select("repo_id", "sha", "subject").join(on, ["repo_id", "sha"], "left").join(branches, ["repo_id", "sha"], "left")
        .join(main, "repo_id", "left").select("repo_id", "sha", "subject", F.when(F.col("on_default"), F.col("main")).otherwise(F.col("branch")).alias("branch"))
    )
    inside = "repo_id is not null and rel_path is not null"
    subjects = M.session_file_subjects(patches.where(inside)).withColumn("ignored", F.lit(False))
    lines = materialize(M.net_session_file(patch_lines.where(inside)).join(subjects.select(*FILE_KEY, "edit_ms"), FILE_KEY), "net-lines")
    hits = M.since_first_edit(M.touched_only(history.lines, lines), lines, margin_ms)
    hits = hits.join(on, ["repo_id", "sha"], "left").withColumn("on_default", F.coalesce("on_default", F.lit(False)))
    out = M.classify(subjects, lines, hits, history.snapshots, FILE_KEY, G.reverted_commits(history.commits), commits)
    return out.withColumnsRenamed({"subject": "first_subject", "branch": "first_branch"}).withColumn("computed_ms", F.lit(now_ms).cast("long"))


def scan(
    logs: list[Logs], providers: list[str], repos: DataFrame, history: History, store: str, now_ms: int,
    threads: ThreadRules = ThreadRules(), loops: LoopRules = LoopRules(), insights: InsightRules = InsightRules(),
) -> Scan:
    """`logs` of the dialects named by `providers`; `repos` (repo_id, root_path); events and patches go to `store`."""
    spark = repos.sparkSession
    events = _in_file_order(_union([one.events for one in logs]), "seq")
    events = fingerprints(I.drop_copies(events, I.event_copy_key(), ORDER)).withColumn("event_id", F.col("fingerprint"))
    events, seen = _store(events, f"{store}/events", ["fingerprint"])
    usage = _in_file_order(_union([one.usage for one in logs]).withColumn("seq", F.lit(0)), "seq")
    usage = materialize(merge_usage(I.drop_copies(usage, I.usage_copy_key(), ORDER)), "usage")
    edits = _in_file_order(_union([one.patches for one in logs]), "pos")
    edits = I.drop_copies(edits, I.patch_copy_key(), ORDER)
    at = F.timestamp_millis("ts_ms")
    key = patch_key(F.col("session_id"), F.col("call_id"), F.col("path"), at, F.col("operation"), F.col("added_fps"), F.col("removed_fps"))
    edits, patched = _store(edits.withColumn("patch_id", key), f"{store}/edits", ["patch_id"])
    sessions = materialize(_sessions(logs, events, edits, usage, repos, providers), "sessions")
    patches = materialize(I.place_patches(edits, repos, sessions.select("session_id", "repo_root")), "patches")
    lines = materialize(_patch_lines(patches), "patch-lines")
    outcomes = materialize(judge_files(patches, lines, history, now_ms), "outcomes")
    defaults = G.default_branch(history.refs)
    groups, members, evidence = T.build_threads(sessions, patches, lines, outcomes, defaults, now_ms, threads)
    groups, members = materialize(groups, "threads"), materialize(members, "members")
    landed = outcomes.where("class = 'landed'").select("session_id", "rel_path")
    inside = "repo_id is not null and rel_path is not null"
    return Scan(
        events, patches, lines, sessions, outcomes, groups, members, evidence,
        D.detect_loops(sessions, groups, members, patches, outcomes, now_ms, loops),
        C.detect_collisions(patches.where(inside), lines.where(inside), sessions, landed, loops),
        D.detect_insights(sessions, outcomes, S.failure_groups(events, insights.repeated_failure_min)),
        I.scan_report(spark, [*seen, *patched]),
    )

"""Open loops and insights as grouped rules over outcomes, sessions and threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklake.config import InsightRules, LoopRules
from worklake.functions.text import base36, compact_count, fnv1a
from worklake.operators.ordered import join_known, materialize

LOOP_COLUMNS = [
    "loop_key", "type", "repo_id", "thread_id", "since_ms", "files", "lines", "commits",
    "sessions", "branch", "status", "provenance",
]


def first_edits(patches: DataFrame) -> DataFrame:
    return patches.groupBy("session_id", "rel_path").agg(F.min("ts_ms").alias("first_edit_ms"))


def _placed_outcomes(outcomes: DataFrame, patches: DataFrame, members: DataFrame, rules: LoopRules) -> DataFrame:
    """Session-file outcomes with since_ms, their group (thread or session) and whether their folder is ignored."""
    ignored = F.lit(False)
    for prefix in rules.ignore_prefixes:
        ignored = ignored | F.coalesce(F.col("rel_path").startswith(prefix), F.lit(False))
    return (
        outcomes.withColumn("ignored", ignored)
        .join(first_edits(patches), ["session_id", "rel_path"], "left")
        .join(members.select("session_id", "thread_id"), "session_id", "left")
        .withColumn("since_ms", F.coalesce("first_edit_ms", "computed_ms"))
        .withColumn("group_key", F.coalesce("thread_id", "session_id"))
    )


def loop_outcomes(
    outcomes: DataFrame, patches: DataFrame, members: DataFrame, rules: LoopRules = LoopRules()
) -> DataFrame:
    """Session-file outcomes outside ignored folders, with since_ms and their group (thread or session).

    `members` are (session_id, thread_id).
    """
    return _placed_outcomes(outcomes, patches, members, rules).where("not ignored").drop("ignored")


def _loop(df: DataFrame, key: Column, kind: str, provenance: str) -> DataFrame:
    have = dict.fromkeys(df.columns)
    df = df.withColumn("loop_key", key).withColumn("type", F.lit(kind)).withColumn(
        "provenance", F.lit(provenance)
    )
    for c in LOOP_COLUMNS:
        if c not in df.columns:
            kind_of = "string" if c in ("branch", "status", "thread_id", "repo_id") else "long"
            df = df.withColumn(c, F.lit(None).cast(kind_of))
    return df.select(*LOOP_COLUMNS)


def _group(df: DataFrame) -> DataFrame:
    return df.groupBy("group_key").agg(
        F.min("repo_id").alias("repo_id"),
        F.max("thread_id").alias("thread_id"),
        F.min("since_ms").alias("since_ms"),
        F.count("*").alias("files"),
        F.sum("line_count").alias("lines"),
        F.countDistinct("session_id").alias("sessions"),
        F.bool_or(F.col("class") == "landed").alias("any_landed"),
    )


def uncommitted_output(found: DataFrame, now_ms: int, rules: LoopRules = LoopRules()) -> DataFrame:
    g = _group(found.where("class = 'uncommitted'"))
    g = g.where(
        (F.lit(now_ms) - F.col("since_ms") >= rules.uncommitted_ms) & (F.col("lines") >= rules.min_lines)
    )
    return _loop(g, F.concat(F.lit("uncommitted-output:"), "group_key"), "uncommitted-output", "derived")


def lost_work(found: DataFrame, rules: LoopRules = LoopRules()) -> DataFrame:
    g = _group(found.where("class in ('lost', 'landed')"))
    g = g.where(~F.col("any_landed") & (F.col("lines") >= rules.lost_min_lines))
    return _loop(g, F.concat(F.lit("lost-work:"), "group_key"), "lost-work", "derived")


def unmerged_branch(
    found: DataFrame, sessions: DataFrame, threads: DataFrame, now_ms: int, rules: LoopRules = LoopRules()
) -> DataFrame:
    """Committed work that never reached the default branch, one loop per repo and branch.

    The branch of the commit wins over the session's own and the thread's.
    """
    own = sessions.select("session_id", "git_branch_start", "git_branch_end", "last_ms")
    thread_branch = threads.select("thread_id", F.col("branch").alias("thread_branch"))
    rows = found.where("class = 'landed' and frac_on_default = 0").join(own, "session_id", "left")
    rows = join_known(rows, thread_branch, ["thread_id"])
    branch = F.coalesce("first_branch", "git_branch_end", "git_branch_start", "thread_branch")
    rows = rows.withColumn("named", branch.isNotNull()).withColumn(
        "branch_key", F.coalesce(branch, F.concat(F.lit("thread:"), "group_key"))
    )
    g = rows.groupBy(F.coalesce("repo_id", F.lit("")).alias("repo_id"), "branch_key").agg(
        F.min("since_ms").alias("since_ms"),
        F.count("*").alias("files"),
        F.sum("line_count").alias("lines"),
        F.countDistinct("first_sha").alias("commits"),
        F.countDistinct("session_id").alias("sessions"),
        F.max(F.coalesce("last_ms", F.lit(0))).alias("active_ms"),
        F.bool_or("named").alias("named"),
    )
    g = g.where(
        (F.lit(now_ms) - F.col("active_ms") >= rules.unmerged_ms) & (F.col("lines") >= rules.min_lines)
    ).withColumn("branch", F.when(F.col("named"), F.col("branch_key")))
    key = F.concat_ws(":", F.lit("unmerged-agent-branch"), "repo_id", "branch_key")
    return _loop(g, key, "unmerged-agent-branch", "derived")


def _later_in_thread(sessions: DataFrame, members: DataFrame, landed: DataFrame) -> DataFrame:
    """Sessions with the latest start of their thread, and the latest start that landed.

    Two map-side combined maxima per thread replace a self-join. The session itself can only be
    the maximum when nothing starts later, so comparing with its own last event is exact.
    """
    flag = landed.select("session_id", F.lit(True).alias("landed")).distinct()
    rows = sessions.join(members.select("session_id", "thread_id"), "session_id", "left").join(
        flag, "session_id", "left"
    )
    latest = rows.where("thread_id is not null").groupBy("thread_id").agg(
        F.max("started_ms").alias("thread_start"),
        F.max(F.when(F.col("landed"), F.col("started_ms"))).alias("thread_landed_start"),
    )
    return join_known(rows, latest, ["thread_id"])


def awaiting_user(
    sessions: DataFrame, members: DataFrame, landed: DataFrame, now_ms: int, rules: LoopRules = LoopRules()
) -> DataFrame:
    return _awaiting(_later_in_thread(sessions, members, landed), now_ms, rules)


def _awaiting(rows: DataFrame, now_ms: int, rules: LoopRules) -> DataFrame:
    last = F.col("last_ms")
    keep = (
        (F.col("status") == "awaiting-user")
        & ~F.coalesce(F.col("thread_start") > last, F.lit(False))
        & (F.lit(now_ms) - last >= rules.awaiting_ms)
    )
    out = rows.where(keep).withColumn("since_ms", last).withColumn("sessions", F.lit(1).cast("long"))
    return _loop(out, F.concat(F.lit("awaiting-user:"), "session_id"), "awaiting-user", "inferred")


def failed_unresolved(
    sessions: DataFrame, members: DataFrame, landed: DataFrame, now_ms: int, rules: LoopRules = LoopRules()
) -> DataFrame:
    return _failed(_later_in_thread(sessions, members, landed), now_ms, rules)


def _failed(rows: DataFrame, now_ms: int, rules: LoopRules) -> DataFrame:
    last = F.col("last_ms")
    keep = (
        F.col("status").isin("failed", "interrupted")
        & F.col("parent_session_id").isNull()
        & (F.lit(now_ms) - last >= rules.failed_ms)
        & ~F.coalesce(F.col("thread_landed_start") > last, F.lit(False))
    )
    out = rows.where(keep).withColumn("since_ms", last).withColumn("sessions", F.lit(1).cast("long"))
    return _loop(out, F.concat(F.lit("failed-unresolved:"), "session_id"), "failed-unresolved", "derived")


def detect_loops(
    sessions: DataFrame, threads: DataFrame, members: DataFrame, patches: DataFrame,
    outcomes: DataFrame, now_ms: int, rules: LoopRules = LoopRules(),
) -> DataFrame:
    """All loops. Outcomes of the classes that make loops are placed once and written, as are sessions that wait or failed."""
    own = outcomes.where("class in ('uncommitted', 'lost', 'landed')").select(
        "session_id", "repo_id", "rel_path", "class", "line_count", "first_sha", "first_branch", "frac_on_default", "computed_ms"
    )
    placed = materialize(_placed_outcomes(own, patches, members, rules).drop("first_edit_ms"), "loop-outcomes")
    found = placed.where("not ignored")
    later = _later_in_thread(sessions, members, placed.where("class = 'landed'"))
    stopped = materialize(later.where("status in ('awaiting-user', 'failed', 'interrupted')"), "loop-sessions")
    parts = [
        uncommitted_output(found, now_ms, rules),
        unmerged_branch(found, sessions, threads, now_ms, rules),
        lost_work(found, rules),
        _awaiting(stopped, now_ms, rules),
        _failed(stopped, now_ms, rules),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def loop_files(found: DataFrame, cls: str) -> DataFrame:
    """Evidence: the files of each group; a display takes the earliest it has room for."""
    return found.where(F.col("class") == cls).select("group_key", "rel_path", "since_ms")


def repeated_failures(groups: DataFrame, rules: InsightRules = InsightRules()) -> DataFrame:
    """`groups` are failure groups: session_id, signature, n, first_ms, last_ms."""
    key = F.concat_ws(":", F.lit("repeated-failure"), "session_id", base36(fnv1a(F.col("signature"))))
    return groups.where(F.col("n") >= rules.repeated_failure_min).select(
        key.alias("insight_key"),
        F.lit("repeated-failure").alias("type"),
        F.lit("warning").alias("severity"),
        F.concat(F.lit("`"), "signature", F.lit("` failed "), F.col("n").cast("string"), F.lit(" times in one session")).alias("message"),
        "session_id",
        F.col("last_ms").alias("created_ms"),
    )


def broken_sessions(sessions: DataFrame) -> DataFrame:
    failed = F.col("status") == "failed"
    return sessions.where("status in ('failed', 'interrupted') and parent_session_id is null").select(
        F.concat(F.col("status"), F.lit("-session:"), "session_id").alias("insight_key"),
        F.when(failed, "failed-session").otherwise("interrupted-session").alias("type"),
        F.when(failed, "warning").otherwise("info").alias("severity"),
        F.when(failed, "Session ended with an error").otherwise("Session was interrupted").alias("message"),
        "session_id",
        F.col("last_ms").alias("created_ms"),
    )


def idle_tokens(sessions: DataFrame, outcomes: DataFrame, rules: InsightRules = InsightRules()) -> DataFrame:
    """Sessions whose many tokens went into work of which nothing landed."""
    known = outcomes.where("class <> 'unknown'").groupBy("session_id").agg(
        F.bool_and(F.col("class").isin("lost", "uncommitted")).alias("idle")
    )
    tokens = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    rows = sessions.join(known.where("idle"), "session_id").withColumn("tokens", tokens)
    return rows.where(F.col("tokens") >= rules.idle_tokens_min).select(
        F.concat(F.lit("tokens-on-non-landed:"), "session_id").alias("insight_key"),
        F.lit("tokens-on-non-landed").alias("type"),
        F.lit("info").alias("severity"),
        F.concat(compact_count(F.col("tokens")), F.lit(" tokens went into work that has not landed (attributed by session)")).alias("message"),
        "session_id",
        F.col("last_ms").alias("created_ms"),
    )


def detect_insights(sessions: DataFrame, outcomes: DataFrame, groups: DataFrame) -> DataFrame:
    return (
        repeated_failures(groups)
        .unionByName(broken_sessions(sessions))
        .unionByName(idle_tokens(sessions, outcomes))
    )


# Loop labels.
LOOP_LABELS = {
    "uncommitted-output": "Uncommitted agent output",
    "unmerged-agent-branch": "Unmerged agent branch",
    "orphan-worktree": "Orphaned worktree",
    "awaiting-user": "Waiting for your answer",
    "failed-unresolved": "Failed, never resolved",
    "lost-work": "Agent work that was lost",
}


def describe_loops(loops: DataFrame) -> DataFrame:
    """Adds label and description; expects `repo` (display name) next to the loop columns."""
    label = F
    for kind, text in LOOP_LABELS.items():
        label = label.when(F.col("type") == kind, text)
    part = lambda c, unit: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {unit}")))
    size = F.concat_ws(", ", part("files", "files"), part("lines", "lines"), part("commits", "commits"))
    where = (
        F.when(F.col("repo").isNotNull(), F.concat(F.lit(" in "), "repo"))
        .when(F.col("repo_id").isNotNull(), "")
        .otherwise(" outside a git repository")
    )
    described = F.concat(
        label,
        F.when(F.col("branch").isNotNull(), F.concat(F.lit(" on `"), "branch", F.lit("`"))).otherwise(""),
        where,
        F.when(size != "", F.concat(F.lit(" ("), size, F.lit(")"))).otherwise(""),
        F.when(
            (F.col("type") == "failed-unresolved") & F.col("status").isNotNull(),
            F.concat(F.lit(" (session "), "status", F.lit(")")),
        ).otherwise(""),
    )
    return loops.withColumn("label", label).withColumn("description", described)

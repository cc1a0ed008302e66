"""Read models: every view is one function from frames and parameters to a DataFrame.

Common columns: sessions (session_id, provider, parent_session_id, repo_id, started_ms, last_ms,
ended_ms, status, git_branch_start, git_branch_end, title, title_provenance, input_tokens,
output_tokens, cached_tokens, event_count, failure_count, changed_files), outcomes (session_id, repo_id,
rel_path, class, survival, line_count, commit_lag_seconds, first_sha, first_commit_ms,
first_subject, first_branch, frac_on_default), patches (patch_id, session_id, repo_id, rel_path,
ts_ms, added_raw, removed_raw).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklake.config import DAY, LIVE_WINDOW_MS, MIN_COMPARISON_SAMPLE
from worklake.functions.paths import path_category, under_path
from worklake.functions.text import agent_name, wilson
from worklake.operators.ordered import pick_rank, top_n
from worklake.operators.search import search_threads, verdict
from worklake.operators.sessions import fold_subagents, is_running

CLASSES = ["landed", "uncommitted", "partial", "lost", "superseded", "unknown"]
KNOWN = ["landed", "uncommitted", "partial", "lost"]


def class_counts(classes: list[str] = CLASSES) -> list[Column]:
    return [F.count_if(F.col("class") == c).alias(c) for c in classes]


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One-row frames with distinct columns as one row, without a join."""
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


# Sessions


def active_between(sessions: DataFrame, from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
    out = sessions
    if to_ms is not None:
        out = out.where(F.col("started_ms") < to_ms)
    if from_ms is not None:
        out = out.where(F.coalesce("ended_ms", "last_ms") >= from_ms)
    return out


def list_tokens() -> Column:
    """Lists show all tokens; without input tokens nothing was reported."""
    return F.when(
        F.col("input_tokens").isNotNull(),
        F.col("input_tokens")
        + F.coalesce("output_tokens", F.lit(0))
        + F.coalesce("cached_tokens", F.lit(0)),
    )


def sessions_list(
    sessions: DataFrame, now_ms: int, *, from_ms=None, to_ms=None, provider=None, repo_id=None,
    status=None, subagents=False, with_files=False, limit: int, offset=0,
) -> DataFrame:
    rows = active_between(sessions, from_ms, to_ms)
    for col, value in (("provider", provider), ("repo_id", repo_id), ("status", status)):
        if value is not None:
            rows = rows.where(F.col(col) == value)
    subs = rows.where("parent_session_id is not null").groupBy(
        F.col("parent_session_id").alias("session_id")
    ).agg(F.count("*").alias("subagents"))
    shown = rows if subagents else rows.where("parent_session_id is null")
    if with_files:
        shown = shown.where("changed_files > 0")
    page = shown.orderBy(F.desc("started_ms"), F.desc("session_id")).offset(offset).limit(limit)
    return page.join(subs, "session_id", "left").fillna({"subagents": 0}).withColumn(
        "tokens", list_tokens()
    ).withColumn("running", is_running(now_ms))


def session_files(patches: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per session and file: edits, raw line counts, last edit and the file's outcome."""
    f = patches.groupBy("session_id", F.coalesce("rel_path", "path").alias("rel_path")).agg(
        F.count("*").alias("edits"),
        F.sum("added_raw").alias("added"),
        F.sum("removed_raw").alias("removed"),
        F.max("ts_ms").alias("last_edit_ms"),
    )
    return f.join(
        outcomes.select("session_id", "rel_path", "class", "first_sha", "first_subject"),
        ["session_id", "rel_path"], "left",
    )


def window_summary(
    sessions: DataFrame, outcomes: DataFrame, loops: DataFrame, now_ms: int, days: int = 7
) -> DataFrame:
    active = active_between(sessions, now_ms - days * DAY)
    top = F.col("parent_session_id").isNull()
    a = active.agg(
        F.count_if(top).alias("sessions"),
        F.countDistinct(F.when(top, F.col("provider"))).alias("agents"),
        F.countDistinct("repo_id").alias("repos"),
        F.count_if(top & is_running(now_ms)).alias("running"),
    )
    o = outcomes.join(active.select("session_id"), "session_id", "left_semi").agg(
        F.count_if(F.col("class") == "landed").alias("files_landed"),
        F.count_if(F.col("class").isin("uncommitted", "partial")).alias("files_waiting"),
        F.count_if(F.col("class") == "lost").alias("files_lost"),
    )
    l = loops.agg(F.count_if(F.col("state") == "open").alias("open_loops"))
    return side_by_side(a, o, l)


# Outcomes


def outcome_distribution(
    outcomes: DataFrame, sessions: DataFrame, *, provider=None, repo_id=None, from_ms=None, to_ms=None,
    by: list[str] = (),
) -> DataFrame:
    """Counts by class after the usual filters; `by` adds grouping columns."""
    s = sessions
    if provider is not None:
        s = s.where(F.col("provider") == provider)
    if from_ms is not None:
        s = s.where(F.col("started_ms") >= from_ms)
    if to_ms is not None:
        s = s.where(F.col("started_ms") < to_ms)
    o = outcomes if repo_id is None else outcomes.where(F.col("repo_id") == repo_id)
    joined = o.join(s.select("session_id", "provider", "started_ms"), "session_id")
    return joined.groupBy(*by, "class").agg(F.count("*").alias("n"))


def fit_cells(outcomes: DataFrame, sessions: DataFrame, from_ms: int | None = None) -> DataFrame:
    """Agents compared inside one repository and file category, only with enough outcomes each."""
    s = sessions.select("session_id", "provider", "started_ms")
    if from_ms is not None:
        s = s.where(F.col("started_ms") >= from_ms)
    rows = outcomes.where("class <> 'unknown' and repo_id is not null").join(s, "session_id")
    cells = rows.groupBy("repo_id", path_category(F.col("rel_path")).alias("category"), "provider").agg(
        F.count("*").alias("total"), *class_counts(KNOWN)
    )
    return _comparable(cells, ["repo_id", "category"])


def _comparable(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells whose group has several agents, all with the minimum sample (few agents per group)."""
    gate = cells.groupBy(*keys).agg(F.count("*").alias("__agents"), F.min("total").alias("__least"))
    ok = gate.where((F.col("__agents") > 1) & (F.col("__least") >= MIN_COMPARISON_SAMPLE))
    return cells.join(ok.select(*keys), keys, "left_semi")


def agent_comparison(outcomes: DataFrame, sessions: DataFrame, from_ms: int | None = None) -> DataFrame:
    """Per repository and agent with the 90% interval of the landed share; unknown outcomes count."""
    s = sessions.where("provider <> 'unknown'").select("session_id", "provider", "started_ms")
    if from_ms is not None:
        s = s.where(F.col("started_ms") >= from_ms)
    cells = outcomes.where("repo_id is not null").join(s, "session_id").groupBy("repo_id", "provider").agg(
        F.count("*").alias("total"), *class_counts(KNOWN + ["unknown"])
    )
    judged = F.col("landed") + F.col("uncommitted") + F.col("partial") + F.col("lost")
    w = wilson(F.col("landed"), judged)
    return _comparable(cells, ["repo_id"]).select(
        "*", w["lo"].alias("landed_lo"), w["hi"].alias("landed_hi")
    )


def outcome_mix(outcomes: DataFrame, sessions: DataFrame, from_ms: int | None = None) -> DataFrame:
    """Overall mix and survival of landed work as (section, name, n)."""
    rows = outcomes
    if from_ms is not None:
        keep = sessions.where(F.col("started_ms") >= from_ms).select("session_id")
        rows = rows.join(keep, "session_id", "left_semi")
    mix = rows.groupBy(F.lit("class").alias("section"), F.col("class").alias("name")).agg(F.count("*").alias("n"))
    kept = rows.where("class = 'landed'").groupBy(
        F.lit("survival").alias("section"), F.col("survival").alias("name")
    ).agg(F.count("*").alias("n"))
    return mix.unionByName(kept)


def commit_lag(outcomes: DataFrame, by: list[str] = ()) -> DataFrame:
    """Median and p90 commit lag in hours by `sorted[floor(n * q)]`."""
    rows = outcomes.where("class = 'landed' and commit_lag_seconds is not null")
    keys = list(by)
    if not keys:
        rows, keys = rows.withColumn("all", F.lit("all")), ["all"]
    picked = pick_rank(rows, keys, "commit_lag_seconds", {"median": 0.5, "p90": 0.9}, 3600)
    return picked.select(
        *by, "n", (F.col("median") / 3600).alias("median_hours"), (F.col("p90") / 3600).alias("p90_hours")
    )


def unknown_reasons(patch_outcomes: DataFrame) -> DataFrame:
    return patch_outcomes.where("class = 'unknown'").groupBy(
        F.coalesce("unknown_reason", F.lit("?")).alias("reason")
    ).agg(F.count("*").alias("n"))


def repo_outcomes(outcomes: DataFrame, sessions: DataFrame, repos: DataFrame) -> DataFrame:
    """Dashboard row per repository: totals by class and agents, most outcomes first."""
    rows = outcomes.join(sessions.select("session_id", "provider"), "session_id")
    agg = rows.groupBy("repo_id").agg(
        F.count("*").alias("total"), F.countDistinct("provider").alias("agents"), *class_counts()
    )
    return repos.join(agg, "repo_id").orderBy(F.desc("total"), "repo_id")


def mix_parity(outcomes: DataFrame, sessions: DataFrame, baseline: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Class shares per agent in percent against a baseline (provider, class, pct)."""
    counts = outcome_distribution(outcomes.where("class <> 'unknown'"), sessions, by=["provider"])
    total = counts.groupBy("provider").agg(F.sum("n").alias("total"))
    share = counts.join(total, "provider").withColumn("pct", F.round(100 * F.col("n") / F.col("total"), 1))
    j = baseline.withColumnRenamed("pct", "base_pct").join(share, ["provider", "class"], "left").fillna({"pct": 0.0})
    delta = F.round(F.col("pct") - F.col("base_pct"), 1)
    return j.select(
        "provider", "class", "pct", "base_pct", delta.alias("delta"), (F.abs(delta) <= tolerance).alias("ok")
    )


# Threads, loops, collisions, insights


def thread_mix(threads: DataFrame, members: DataFrame, outcomes: DataFrame) -> DataFrame:
    mix = (
        outcomes.where("class <> 'unknown'")
        .join(members.select("session_id", "thread_id"), "session_id")
        .groupBy("thread_id")
        .agg(*class_counts(KNOWN))
    )
    return threads.join(mix, "thread_id", "left").fillna(0, KNOWN)


def threads_list(threads: DataFrame, members: DataFrame, outcomes: DataFrame, limit: int, status=None) -> DataFrame:
    rows = threads if status is None else threads.where(F.col("status") == status)
    page = rows.orderBy(F.desc("last_ms"), "thread_id").limit(limit)
    return thread_mix(page, members, outcomes)


def loops_list(loops: DataFrame, state: str | None = None) -> DataFrame:
    rows = loops if state is None else loops.where(F.col("state") == state)
    return rows.orderBy(F.desc(F.coalesce("lines", F.lit(0))), "since_ms", "loop_key")


def loops_for_repo(loops: DataFrame, repo_id: str) -> DataFrame:
    return loops.where((F.col("state") == "open") & (F.col("repo_id") == repo_id)).orderBy(
        F.desc("since_ms"), "loop_key"
    )


def collisions_list(collisions: DataFrame, repo_id=None, since_ms=None) -> DataFrame:
    rows = collisions
    if repo_id is not None:
        rows = rows.where(F.col("repo_id") == repo_id)
    if since_ms is not None:
        rows = rows.where(F.col("end_ms") >= since_ms)
    return rows.orderBy(F.desc("end_ms"), "collision_key")


def insights_list(insights: DataFrame, session_id=None, include_dismissed=False) -> DataFrame:
    rows = insights if include_dismissed else insights.where("dismissed_ms is null")
    if session_id is not None:
        rows = rows.where(F.col("session_id") == session_id)
    return rows.orderBy(F.desc("created_ms"), "insight_key")


# Memory queries


def recent_work(
    sessions: DataFrame, patches: DataFrame, outcomes: DataFrame, repo_id: str, now_ms: int, *,
    path: str | None = None, days: int = 7, limit: int, files: int,
) -> DataFrame:
    """Latest sessions of a repository (sub-agents folded in), one row per shown file."""
    active = active_between(sessions.where(F.col("repo_id") == repo_id), now_ms - days * DAY)
    folded = fold_subagents(active)
    work = folded_files(folded, patches, outcomes)
    if path is not None:
        work = work.where(under_path(F.col("rel_path"), F.lit(path)))
    counts = work.groupBy("root_session_id").agg(F.count("*").alias("files"))
    roots = folded.where("root_session_id = session_id").drop("root_session_id")
    j = roots.join(counts.withColumnRenamed("root_session_id", "session_id"), "session_id", "left")
    if path is not None:
        j = j.where("files is not null")
    page = j.orderBy(F.desc("last_ms"), F.desc("session_id")).limit(limit).select(
        "session_id", agent_name(F.col("provider")).alias("agent"),
        F.coalesce("git_branch_end", "git_branch_start").alias("branch"), "last_ms", "status",
        is_running(now_ms).alias("running"), F.coalesce("files", F.lit(0)).alias("files"),
    )
    shown = top_n(work, ["root_session_id"], [F.desc("last_edit_ms"), F.asc("rel_path")], files, "file_no")
    return page.join(shown.withColumnRenamed("root_session_id", "session_id"), "session_id", "left")


def folded_files(
    folded: DataFrame, patches: DataFrame, outcomes: DataFrame, newest: bool = False
) -> DataFrame:
    """Per root session and file: edits, last edit and one outcome.

    Where a session and its sub-agents both have an outcome for a file, lists show the one that
    started first (they read newest first and let the last win), threads the newest.
    """
    pick = F.max_by if newest else F.min_by
    m = folded.select("session_id", "root_session_id", "started_ms")
    edits = patches.where("rel_path is not null").join(m, "session_id").groupBy(
        "root_session_id", "rel_path"
    ).agg(F.count("*").alias("edits"), F.max("ts_ms").alias("last_edit_ms"))
    states = outcomes.join(m, "session_id").groupBy("root_session_id", "rel_path").agg(
        pick(
            F.struct("class", "first_sha", "first_subject"), F.struct("started_ms", "session_id")
        ).alias("o")
    )
    return edits.join(states, ["root_session_id", "rel_path"], "left").select(
        "root_session_id", "rel_path", "edits", "last_edit_ms", F.col("o.class").alias("class"),
        F.substring("o.first_sha", 1, 9).alias("sha"), F.col("o.first_subject").alias("subject"),
    )


def active_conflicts(
    sessions: DataFrame, patches: DataFrame, outcomes: DataFrame, repo_id: str, paths: list[str], now_ms: int
) -> DataFrame:
    """Running sessions of a repository and how many of their files fall under the given paths."""
    live = sessions.where(F.col("repo_id") == repo_id)
    live = active_between(live, now_ms - LIVE_WINDOW_MS).where(is_running(now_ms))
    folded = fold_subagents(live)
    hit = F.lit(False)
    for p in paths:  # the caller's own few paths
        hit = hit | under_path(F.col("rel_path"), F.lit(p))
    work = folded_files(folded, patches, outcomes).groupBy("root_session_id").agg(
        F.count("*").alias("editing"), F.count_if(hit).alias("overlaps")
    )
    roots = folded.where("root_session_id = session_id").drop("root_session_id")
    return roots.join(work.withColumnRenamed("root_session_id", "session_id"), "session_id", "left").select(
        "session_id", agent_name(F.col("provider")).alias("agent"), "status", "started_ms", "last_ms",
        F.coalesce("editing", F.lit(0)).alias("editing"),
        F.coalesce("overlaps", F.lit(0)).alias("overlaps"),
    )


def prior_attempts(
    fields: DataFrame, threads: DataFrame, members: DataFrame, outcomes: DataFrame, terms: list[str],
    limit: int,
) -> DataFrame:
    """Best matching threads with their outcome mix and verdict."""
    found = search_threads(fields, terms).join(
        threads.select("thread_id", "repo_id", "title", "status", "started_ms", "last_ms", "sessions"), "thread_id"
    )
    best = found.orderBy(
        F.desc("matched"), F.desc("score"), F.desc("last_ms"), F.asc("thread_id")
    ).limit(limit)
    mixed = thread_mix(best, members, outcomes)
    return mixed.withColumn(
        "result", verdict(*[F.col(c) for c in ("landed", "uncommitted", "partial", "lost")])
    )


def latest_thread(
    threads: DataFrame, members: DataFrame, outcomes: DataFrame, repo_id: str, branch: str | None = None
) -> DataFrame:
    """The most recent thread of a repository with recorded edits."""
    edited = outcomes.where(F.col("repo_id") == repo_id).select("session_id").distinct()
    own = members.join(edited, "session_id", "left_semi").select("thread_id").distinct()
    rows = threads.where(F.col("repo_id") == repo_id).join(own, "thread_id", "left_semi")
    if branch is not None:
        rows = rows.where(F.col("branch") == branch)
    return rows.orderBy(F.desc("last_ms"), "thread_id").limit(1)


def resume_steps(
    members: DataFrame, sessions: DataFrame, patches: DataFrame, outcomes: DataFrame
) -> DataFrame:
    """Per thread and top-level session: files edited and their outcome mix."""
    s = sessions.drop("thread_id").join(members.select("session_id", "thread_id"), "session_id")
    folded = _fold_in_thread(s)
    work = folded_files(folded, patches, outcomes, newest=True).groupBy("root_session_id").agg(
        F.count("*").alias("files"), *class_counts(KNOWN)
    )
    roots = folded.where("root_session_id = session_id").select(
        "thread_id", "session_id", "provider", "title", "started_ms", "last_ms"
    )
    return roots.join(work.withColumnRenamed("root_session_id", "session_id"), "session_id", "left").fillna(
        0, ["files", *KNOWN]
    )


def _fold_in_thread(s: DataFrame) -> DataFrame:
    ids = s.select(
        F.col("session_id").alias("parent_session_id"), "thread_id", F.lit(True).alias("__in")
    )
    return s.join(ids, ["parent_session_id", "thread_id"], "left").withColumn(
        "root_session_id",
        F.when(F.col("__in"), F.col("parent_session_id")).otherwise(F.col("session_id")),
    ).drop("__in")


def resume_files(members: DataFrame, sessions: DataFrame, patches: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Newest state of each file across a thread: the last step that edited it decides."""
    s = sessions.drop("thread_id").join(members.select("session_id", "thread_id"), "session_id")
    folded = _fold_in_thread(s)
    steps = folded.where("root_session_id = session_id").select(
        F.col("session_id").alias("root_session_id"), "thread_id", F.col("started_ms").alias("step_ms")
    )
    work = folded_files(folded, patches, outcomes, newest=True).join(steps, "root_session_id")
    return work.groupBy("thread_id", "rel_path").agg(
        F.max_by(
            F.struct("class", "sha", "subject"), F.struct("step_ms", "root_session_id")
        ).alias("f")
    ).select("thread_id", "rel_path", "f.*")


def resume_failures(members: DataFrame, groups: DataFrame, n: int) -> DataFrame:
    rows = groups.join(members.select("session_id", "thread_id"), "session_id")
    return top_n(rows, ["thread_id"], [F.desc("last_ms"), F.asc("signature"), F.asc("session_id")], n)


def data_as_of(sessions: DataFrame, last_scan_ms: int | None) -> DataFrame:
    newest = sessions.agg(F.max("last_ms").alias("newest_ms"))
    return newest.select(F.greatest("newest_ms", F.lit(last_scan_ms)).alias("as_of_ms"))


# Brief and report


def _within(col: str, from_ms: int, to_ms: int) -> Column:
    return (F.col(col) >= from_ms) & (F.col(col) < to_ms)


def brief_activity(sessions: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """Sessions, agents, repositories and usage of a day, one row."""
    a = active_between(sessions, from_ms, to_ms).where(F.col("last_ms") >= from_ms)
    used = (F.col("usage_coverage") == "complete") | F.col("input_tokens").isNotNull()
    total = lambda c: F.coalesce(F.sum(F.when(used, F.coalesce(c, F.lit(0)))), F.lit(0))
    agg = a.agg(
        F.count("*").alias("__n"),
        F.count_if(F.col("parent_session_id").isNull()).alias("sessions"),
        F.countDistinct("provider").alias("providers"),
        F.countDistinct("repo_id").alias("repos"),
        F.count_if(used).alias("sessions_with_usage"),
        total("input_tokens").alias("input_tokens"),
        total("output_tokens").alias("output_tokens"),
        total("cached_tokens").alias("cached_tokens"),
    )
    coverage = (
        F.when(F.col("sessions_with_usage") == 0, "none")
        .when(F.col("sessions_with_usage") == F.col("__n"), "complete")
        .otherwise("partial")
    )
    return agg.withColumn("coverage", coverage).drop("__n")


def brief_mix(sessions: DataFrame, outcomes: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    a = active_between(sessions, from_ms, to_ms).where(F.col("last_ms") >= from_ms)
    rows = outcomes.where("class <> 'unknown'").join(a.select("session_id"), "session_id", "left_semi")
    return rows.groupBy("class").agg(F.count("*").alias("n"))


def brief_left_off(threads: DataFrame, from_ms: int, to_ms: int, n: int) -> DataFrame:
    rows = threads.where(F.col("status").isin("dangling", "active", "unknown")).where(
        _within("last_ms", from_ms - 2 * DAY, to_ms)
    )
    return rows.orderBy(F.desc("last_ms"), "thread_id").limit(n)


def brief_loops(loops: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    o = loops.where("state = 'open'")
    return o.agg(
        F.count("*").alias("open"),
        F.count_if(_within("since_ms", from_ms, to_ms)).alias("new_today"),
        F.min("since_ms").alias("oldest_ms"),
    )


def brief_top_loops(loops: DataFrame, to_ms: int, n: int) -> DataFrame:
    age = F.greatest(F.lit(1.0), (F.lit(to_ms) - F.col("since_ms")) / DAY)
    rows = loops.where("state = 'open'").withColumn("severity", F.coalesce("lines", F.lit(0)) * age)
    return rows.orderBy(F.desc("severity"), "since_ms", "loop_key").limit(n)


def brief_landed(outcomes: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """Work landed in the day per repository; commits are counted once each."""
    rows = outcomes.where("class = 'landed'").where(_within("first_commit_ms", from_ms, to_ms))
    return rows.groupBy("repo_id").agg(
        F.count("*").alias("files"), F.sum("line_count").alias("lines"),
        F.countDistinct("first_sha").alias("commits"),
    ).orderBy(F.desc("lines"), "repo_id")


def brief_attention(
    sessions: DataFrame, collisions: DataFrame, insights: DataFrame, from_ms: int, to_ms: int, n: int
) -> DataFrame:
    """What needs a look: broken and waiting sessions, then collisions, then warnings."""
    a = active_between(sessions, from_ms, to_ms).where(F.col("last_ms") >= from_ms)
    place = F.concat(F.lit(" in "), F.coalesce("repo_id", F.lit("no repo")))
    who = F.concat(F.coalesce("title", F.lit("A session")), place)
    broken = a.where("status in ('failed', 'interrupted') and parent_session_id is null").select(
        F.lit(0).alias("section"), (-F.col("started_ms")).alias("pos"), F.lit("failure").alias("kind"),
        F.concat(who, F.when(F.col("status") == "failed", " ended with an error").otherwise(" was interrupted")).alias("message"),
        "session_id",
    )
    waiting = a.where("status = 'awaiting-user'").select(
        F.lit(0).alias("section"), (-F.col("started_ms")).alias("pos"), F.lit("awaiting-user").alias("kind"),
        F.concat(who, F.lit(" is waiting for your answer")).alias("message"), "session_id",
    )
    met = collisions.where(_within("end_ms", from_ms, to_ms)).select(
        F.lit(1).alias("section"), (-F.col("end_ms")).alias("pos"), F.lit("collision").alias("kind"),
        F.concat(
            F.when(F.col("kind") == "overwrite", "One agent overwrote another's unlanded edit in ").otherwise("Two agents edited "),
            "rel_path", F.lit(" ("), "repo_id", F.lit(")"),
        ).alias("message"),
        F.col("session_b").alias("session_id"),
    )
    warned = insights.where("severity = 'warning'").join(a.select("session_id"), "session_id", "left_semi").select(
        F.lit(2).alias("section"), (-F.col("created_ms")).alias("pos"), F.lit("insight").alias("kind"),
        "message", "session_id",
    )
    rows = broken.unionByName(waiting).unionByName(met).unionByName(warned)
    return rows.orderBy("section", "pos", "session_id", "message").limit(n)


def report_sessions(sessions: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    s = sessions.where(_within("started_ms", from_ms, to_ms))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return s.agg(
        F.count_if(F.col("parent_session_id").isNull()).alias("sessions"),
        F.count_if(F.col("parent_session_id").isNotNull()).alias("subagent_sessions"),
        F.countDistinct(F.when(F.col("parent_session_id").isNull(), F.col("provider"))).alias("agents"),
        total("input_tokens").alias("input_tokens"),
        total("output_tokens").alias("output_tokens"),
        total("cached_tokens").alias("cached_tokens"),
    )


def report_outcomes(sessions: DataFrame, outcomes: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """Mix, landed and churned shares and median lag of the period, one row."""
    s = sessions.where(_within("started_ms", from_ms, to_ms)).select("session_id")
    rows = outcomes.where("class <> 'unknown'").join(s, "session_id", "left_semi")
    agg = rows.agg(
        *class_counts(KNOWN),
        F.avg((F.col("class") == "landed").cast("int")).alias("landed_share"),
        F.avg(F.when(F.col("class") == "landed", (F.col("survival") == "churned").cast("int"))).alias("churned_share"),
    )
    return side_by_side(agg, commit_lag(rows).select("median_hours"))


def report_areas(
    sessions: DataFrame, outcomes: DataFrame, from_ms: int, to_ms: int, n: int, area: Column | None = None
) -> DataFrame:
    s = sessions.where(_within("started_ms", from_ms, to_ms)).select("session_id")
    rows = outcomes.where("class <> 'unknown'").join(s, "session_id", "left_semi")
    name = path_category(F.col("rel_path")) if area is None else area
    return rows.groupBy(name.alias("name")).agg(F.count("*").alias("files")).orderBy(
        F.desc("files"), "name"
    ).limit(n)


def report_loops(loops: DataFrame, collisions: DataFrame, threads: DataFrame, from_ms: int, to_ms: int) -> DataFrame:
    """Loops opened and closed, collisions and the biggest thread of the period, one row."""
    l = loops.agg(
        F.count_if(_within("since_ms", from_ms, to_ms)).alias("loops_created"),
        F.count_if((F.col("state") == "resolved") & _within("since_ms", from_ms, to_ms)).alias("loops_closed"),
    )
    c = collisions.agg(F.count_if(_within("end_ms", from_ms, to_ms)).alias("collisions"))
    inside = F.when(_within("started_ms", from_ms, to_ms), F.struct("sessions", (-F.col("started_ms")).alias("s"), "thread_id"))
    days = F.greatest(F.lit(1), F.floor((F.col("last_ms") - F.col("started_ms")) / DAY + 0.5))
    t = threads.agg(F.max_by(F.struct("sessions", F.size("providers").alias("agents"), days.alias("days")), inside).alias("t")).select(
        F.col("t.sessions").alias("biggest_sessions"),
        F.col("t.agents").alias("biggest_agents"),
        F.col("t.days").alias("biggest_days"),
    )
    return side_by_side(l, c, t)


def health_checks(
    sessions: DataFrame, failures: DataFrame, repo_checks: DataFrame, last_scan_ms: int | None, now_ms: int
) -> DataFrame:
    """name, status, n for the data checks."""
    age = None if last_scan_ms is None else (now_ms - last_scan_ms) // DAY
    scan = sessions.sparkSession.range(1).select(
        F.lit("last-scan").alias("name"),
        F.lit("WARN" if age is None or now_ms - last_scan_ms > 7 * DAY else "PASS").alias("status"),
        F.lit(age).cast("long").alias("n"),
    )
    none = lambda name, df: df.select(
        F.lit(name).alias("name"), F.when(F.col("n") == 0, "PASS").otherwise("WARN").alias("status"), "n"
    )
    return (
        scan.unionByName(none("parser-coverage", failures.agg(F.count("*").alias("n"))))
        .unionByName(none("outcome-self-check", repo_checks.where("confidence = 'low'").agg(F.count("*").alias("n"))))
    )


def export_json(view: DataFrame, path: str) -> None:
    """A view as JSON lines."""
    view.select(F.to_json(F.struct(*view.columns)).alias("value")).write.mode("overwrite").text(path)

"""Session state from stored events: aggregates, status, end, timeline, folding of sub-agents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklake.config import LIVE_WINDOW_MS, MINUTE
from worklake.operators.ordered import collapse_runs, join_known, top_n

# Event types that open and close a call.
STARTED = ("tool.started", "command.started", "subagent.started")
FINISHED = (
    "tool.completed", "tool.failed", "command.completed", "command.failed", "subagent.ended",
    "approval.resolved",
)
NEWEST = lambda: [F.desc("ts_ms"), F.desc("seq"), F.desc("event_id")]


def event_counts(events: DataFrame) -> DataFrame:
    """Per session: events, failures, first and last instant."""
    return events.groupBy("session_id").agg(
        F.count("*").alias("event_count"),
        F.count_if(F.col("status") == "failure").alias("failure_count"),
        F.min("ts_ms").alias("first_ms"),
        F.max("ts_ms").alias("last_ms"),
    )


def changed_files(patches: DataFrame) -> DataFrame:
    return patches.groupBy("session_id").agg(F.countDistinct("path").alias("changed_files"))


def latest_events(events: DataFrame, n: int) -> DataFrame:
    """The n newest events of each session, numbered from the newest."""
    return top_n(events, ["session_id"], NEWEST(), n)


def session_status(events: DataFrame) -> DataFrame:
    """Status per session: what the newest decisive event says, over all its events.

    Of each call only the newest start and the newest request can decide, since what closes them closes
    the older ones too. So two aggregations suffice, per call and per session, and nothing is ranked.
    """
    et, call = F.col("event_type"), F.col("call_id")
    place = F.struct("ts_ms", "seq", "event_id")
    newest = lambda when: F.max(F.when(when, place))
    calls = events.groupBy("session_id", "call_id").agg(
        newest(et.isin(*FINISHED)).alias("done"),
        newest(et.isin(*STARTED) & call.isNotNull()).alias("started"),
        newest(et == "approval.requested").alias("requested"),
        F.max(et == "session.awaiting-user").alias("asks"),
        newest(et == "agent.interrupted").alias("interrupted"),
        newest(et == "error").alias("failed"),
        newest(et == "turn.completed").alias("completed"),
        newest(et == "prompt.submitted").alias("prompted"),
    )
    open_since = lambda c: F.when(call.isNull() | F.col("done").isNull() | (F.col("done") < F.col(c)), F.col(c))
    per_session = calls.groupBy("session_id").agg(
        F.max("done").alias("done"),
        F.max(F.when(F.col("asks"), open_since("started"))).alias("asking"),
        F.max(F.when(~F.col("asks"), open_since("started"))).alias("running"),
        F.max(open_since("requested")).alias("requested"),
        *[F.max(c).alias(c) for c in ("interrupted", "failed", "completed", "prompted")],
    )
    waiting = F.when(F.col("done").isNull() | (F.col("done") < F.col("requested")), F.col("requested"))
    said = {
        "interrupted": "interrupted", "asking": "awaiting-user", "running": "unknown", "waiting": "awaiting-user",
        "failed": "failed", "completed": "completed", "prompted": "unknown",
    }
    decisive = F.array_compact(
        F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("at"), F.lit(v).alias("status"))) for c, v in said.items()])
    )
    return per_session.withColumn("waiting", waiting).select(
        "session_id", F.coalesce(F.array_max(decisive)["status"], F.lit("unknown")).alias("status")
    )


def session_end(events: DataFrame) -> DataFrame:
    """End instant: the newest end signal with no activity after it."""
    ends = events.groupBy("session_id").agg(
        F.max(F.when(F.col("event_type") == "session.ended", F.col("ts_ms"))).alias("end"),
        F.max("ts_ms").alias("last"),
    )
    return ends.select("session_id", F.when(F.col("end") >= F.col("last"), F.col("end")).alias("ended_ms"))


def refresh_sessions(
    sessions: DataFrame, events: DataFrame, patches: DataFrame, usage: DataFrame
) -> DataFrame:
    """Stored rows are the truth: counts, span, usage, end and status recomputed per session."""
    from worklake.operators.usage import usage_totals

    base = sessions.select(
        *[c for c in sessions.columns if c not in ("first_ms", "last_ms", "status", "ended_ms")]
    )
    return (
        usage_totals(base, usage)
        .join(event_counts(events), "session_id", "left")
        .join(changed_files(patches), "session_id", "left")
        .join(session_status(events), "session_id", "left")
        .join(session_end(events), "session_id", "left")
        .fillna({"event_count": 0, "failure_count": 0, "changed_files": 0, "status": "unknown"})
    )


def merge_sessions(facts: DataFrame) -> DataFrame:
    """One session from the facts of several passes or files, in pass order.

    Spans widen; the first folder and branch stay; the end branch follows the newest activity; a
    title set by the user outranks generated ones.
    """
    p = F.col("pass_no")
    have = lambda c, order: F.when(F.col(c).isNotNull(), order)
    return facts.groupBy("provider", "session_id").agg(
        F.min("first_ms").alias("first_ms"),
        F.max("last_ms").alias("last_ms"),
        F.min_by("cwd", have("cwd", p)).alias("cwd"),
        F.max_by("parent_session_id", have("parent_session_id", p)).alias("parent_session_id"),
        F.min_by("branch_first", have("branch_first", p)).alias("branch_start"),
        F.max_by("branch_last", have("branch_last", F.struct("last_ms", "pass_no"))).alias("branch_end"),
        F.max_by("model", have("model", p)).alias("model"),
        F.max_by(
            F.struct("title", "title_provenance"),
            have("title", F.struct((F.col("title_provenance") == "observed").alias("o"), "pass_no")),
        ).alias("t"),
    ).select(
        "provider", "session_id", "first_ms", "last_ms", "cwd", "parent_session_id", "branch_start",
        "branch_end", "model", F.col("t.title").alias("title"),
        F.col("t.title_provenance").alias("title_provenance"),
    )


def is_running(now_ms: int, last: str = "last_ms") -> Column:
    ended = F.col("ended_ms").isNotNull() & (F.col("ended_ms") >= F.col(last))
    return (
        ~ended
        & (F.lit(now_ms) - F.col(last) < LIVE_WINDOW_MS)
        & ~F.col("status").isin("failed", "interrupted")
    )


def fold_subagents(sessions: DataFrame) -> DataFrame:
    """Adds root_session_id: the parent when it is among the given sessions, else the session."""
    ids = sessions.select(F.col("session_id").alias("parent_session_id"), F.lit(True).alias("__in"))
    return join_known(sessions, ids, ["parent_session_id"]).withColumn(
        "root_session_id",
        F.when(F.col("__in"), F.col("parent_session_id")).otherwise(F.col("session_id")),
    ).drop("__in")


def event_label() -> Column:
    """Timeline label of an event."""
    et = F.col("event_type")
    # Labels per event type.
    return (
        F.when(et == "prompt.submitted", "Prompt")
        .when(et == "turn.completed", "Turn completed")
        .when(et.isin("command.completed", "command.failed"), F.coalesce("executable", F.lit("Command")))
        .when((et == "edit.applied") & (F.col("file_operation") == "create"), "Created file")
        .when((et == "edit.applied") & (F.col("file_operation") == "delete"), "Deleted file")
        .when(et == "edit.applied", "Edited file")
        .when(et.isin("tool.completed", "tool.failed"), F.coalesce("tool_name", F.lit("Tool")))
        .when(et == "subagent.started", "Subagent started")
        .when(et == "subagent.ended", "Subagent finished")
        .when(et == "approval.resolved", "Permission denied")
        .when(et == "agent.interrupted", "Interrupted")
        .when(et == "session.started", "Session started")
        .when(et == "session.awaiting-user", "Asked you a question")
        .when(et == "error", "Error")
        .otherwise(F.col("provider_event_type"))
    )


def timeline(events: DataFrame, bucket_ms: int = 60 * MINUTE) -> DataFrame:
    """Chronological items per session; consecutive similar events become one with a count.

    Started events are hidden (sub-agents excepted); prompts and turns never merge.
    """
    et = F.col("event_type")
    shown = events.where(~et.endswith(".started") | (et == "subagent.started")).withColumn(
        "label", event_label()
    ).withColumn("detail", F.coalesce("display", "file_path", "error_code"))
    merges = ~et.isin("prompt.submitted", "turn.completed")
    same = F.when(merges, F.struct("event_type", "label"))
    items = collapse_runs(
        shown,
        ["session_id"],
        F.floor(F.col("ts_ms") / bucket_ms),
        ["ts_ms", "seq", "event_id"],
        same,
        [
            F.min_by(
                F.struct("event_type", "label", "detail", "status"),
                F.struct("ts_ms", "seq", "event_id"),
            ).alias("head"),
            F.count("*").alias("count"),
        ],
    )
    return items.select(
        "session_id",
        F.col("run_start.ts_ms").alias("at_ms"),
        F.col("run_start.seq").alias("seq"),
        F.col("run_start.event_id").alias("event_id"),
        F.col("head.event_type").alias("event_type"),
        F.col("head.label").alias("label"),
        F.when(F.col("count") == 1, F.col("head.detail")).alias("detail"),
        F.col("head.status").alias("status"),
        "count",
    )


def failure_groups(events: DataFrame, min_count: int) -> DataFrame:
    """Failed commands and tools per session and signature."""
    failed = events.where(F.col("event_type").isin("command.failed", "tool.failed"))
    return (
        failed.groupBy("session_id", F.coalesce("display", "tool_name", "event_type").alias("signature"))
        .agg(
            F.count("*").alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms")
        )
        .where(F.col("n") >= min_count)
    )


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    """Counts by class per session as a map (at most six classes)."""
    counts = outcomes.groupBy("session_id", "class").agg(F.count("*").alias("n"))
    return counts.groupBy("session_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("class", "n")))).alias("outcome_summary")
    )


def list_events(events: DataFrame, from_ms: int, to_ms: int, types: list[str], limit: int) -> DataFrame:
    """Events in a time range by type, oldest first, limited."""
    return (
        events.where((F.col("ts_ms") >= from_ms) & (F.col("ts_ms") < to_ms) & F.col("event_type").isin(*types))
        .orderBy("ts_ms", "seq", "event_id")
        .limit(limit)
    )

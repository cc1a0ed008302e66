"""Record invariants as rule tables: a name and the condition under which a row breaks it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklake.sources.variants import TIMESTAMP

# The closed vocabularies of the model.
EVENT_TYPES = (
    "session.started", "session.ended", "session.awaiting-user", "prompt.submitted",
    "turn.completed", "tool.started", "tool.completed", "tool.failed", "command.started",
    "command.completed", "command.failed", "file.changed", "edit.applied", "approval.requested",
    "approval.resolved", "usage.reported", "subagent.started", "subagent.ended",
    "agent.interrupted", "error", "unknown",
)
STATUSES = ("active", "completed", "failed", "interrupted", "awaiting-user", "abandoned", "unknown")
OUTCOME_CLASSES = ("landed", "uncommitted", "partial", "lost", "superseded", "unknown")


def _gt(a: str, b: str) -> Column:
    return F.col(a) > F.col(b)


def event_rules() -> dict[str, Column]:
    """Privacy flags must describe what the event carries."""
    return {
        "event-type": ~F.col("event_type").isin(*EVENT_TYPES),
        "prompt-not-declared": F.col("prompt").isNotNull() & ~F.col("prompt_captured"),
        "arguments-not-declared": F.col("tool_arguments").isNotNull() & ~F.col("arguments_captured"),
        "result-not-declared": F.col("tool_result").isNotNull() & ~F.col("result_captured"),
    }


def patch_rules() -> dict[str, Column]:
    return {
        "rel-path-needs-repo": F.col("rel_path").isNotNull() & F.col("repo_id").isNull(),
        "rel-path-shape": F.col("rel_path").startswith("/")
        | F.array_contains(F.split("rel_path", "/"), ".."),
        "more-added-than-raw": F.size("added_fps") > F.col("added_raw"),
        "more-removed-than-raw": F.size("removed_fps") > F.col("removed_raw"),
        "fingerprint-shape": F.exists(
            F.concat("added_fps", "removed_fps"), lambda fp: ~fp.rlike("^[0-9a-f]{16}$")
        ),
    }


def session_rules() -> dict[str, Column]:
    return {
        "status": ~F.col("status").isin(*STATUSES),
        "ended-before-start": F.col("ended_ms") < F.col("started_ms"),
        "last-before-start": F.col("last_ms") < F.col("started_ms"),
        "title-without-provenance": F.col("title").isNotNull() & F.col("title_provenance").isNull(),
        "more-failures-than-events": _gt("failure_count", "event_count"),
    }


def outcome_rules() -> dict[str, Column]:
    unknown = F.col("class") == "unknown"
    return {
        "class": ~F.col("class").isin(*OUTCOME_CLASSES),
        "patch-scope-needs-patch": (F.col("scope") == "patch") & F.col("patch_id").isNull(),
        "reason-iff-unknown": F.col("unknown_reason").isNotNull() != unknown,
        "landed-needs-commit": (F.col("class") == "landed") & F.col("first_sha").isNull(),
        "survival-only-landed": (F.col("class") != "landed") & (F.col("survival") != "unknown"),
        "lag-needs-commit": F.col("commit_lag_seconds").isNotNull() & F.col("first_sha").isNull(),
        "default-above-committed": _gt("frac_on_default", "frac_committed"),
    }


def thread_rules() -> dict[str, Column]:
    return {
        "last-before-start": F.col("last_ms") < F.col("started_ms"),
        "links-missing": (F.col("sessions") > 1) & (F.col("links") == 0),
        "foreign-link": F.col("foreign_links") > 0,
    }


def loop_rules() -> dict[str, Column]:
    return {
        "resolved-by-needs-resolved": F.col("resolved_by").isNotNull() & (F.col("state") != "resolved"),
        "awaiting-is-inferred": (F.col("type") == "awaiting-user") & (F.col("provenance") != "inferred"),
    }


def collision_rules() -> dict[str, Column]:
    return {
        "two-sessions": F.col("session_a") == F.col("session_b"),
        "window-order": F.col("end_ms") < F.col("start_ms"),
        "duplicate-is-inferred": (F.col("kind") == "possible-duplicate") & (F.col("provenance") != "inferred"),
    }


def instant_rules(column: str) -> dict[str, Column]:
    c = F.col(column)
    return {
        "instant-shape": ~c.rlike(TIMESTAMP),
        "instant-calendar": c.rlike(TIMESTAMP) & F.try_to_timestamp(c).isNull(),
    }


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break at least one rule, with the rule names; one pass for all rules."""
    broken = F.array_compact(F.array(*[F.when(cond, name) for name, cond in rules.items()]))
    return df.withColumn("broken", broken).where(F.size("broken") > 0)


def violation_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    counted = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return counted.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("n")) for n in rules])).alias("x")
    ).select("x.*")

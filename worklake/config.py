"""Rule sets as frozen dataclasses; every threshold is a parameter of the operator that uses it."""

from __future__ import annotations

from dataclasses import dataclass

SECOND = 1_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


# The defaults below decide result rows and must not drift.
@dataclass(frozen=True)
class OutcomeRules:
    slack_ms: int = 2 * MINUTE
    landed_share: float = 0.5
    tree_share: float = 0.5
    survival_share: float = 0.5
    control_a_max: float = 0.08
    control_b_max: float = 0.01
    control_min_sample: int = 20


@dataclass(frozen=True)
class ThreadRules:
    max_gap_ms: int = 72 * HOUR
    max_span_ms: int = 7 * DAY
    trunk_span_ms: int = 14 * DAY
    min_jaccard: float = 0.3
    active_ms: int = 2 * HOUR
    abandoned_ms: int = 14 * DAY


@dataclass(frozen=True)
class LoopRules:
    uncommitted_ms: int = 24 * HOUR
    unmerged_ms: int = 7 * DAY
    awaiting_ms: int = 30 * MINUTE
    failed_ms: int = HOUR
    lost_min_lines: int = 20
    min_lines: int = 10
    concurrent_ms: int = HOUR
    overwrite_ms: int = 7 * DAY
    ignore_prefixes: tuple[str, ...] = ("output/", ".planning/")


@dataclass(frozen=True)
class InsightRules:
    repeated_failure_min: int = 3
    idle_tokens_min: int = 200_000


MIN_COMPARISON_SAMPLE = 30
LIVE_WINDOW_MS = 10 * MINUTE
TRUNK_SPAN_MS = 14 * DAY

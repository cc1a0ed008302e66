"""Status stories, oldest event first: (type, call)."""

import pytest

from worklake.bindings import NOW_MS, Domain
from worklake.operators import detect
from worklake.operators.sessions import session_status

STORIES = {
    "completed": ("completed", [("prompt.submitted", None), ("tool.started", "a"), ("tool.completed", "a"), ("turn.completed", None)]),
    "no answer": ("unknown", [("turn.completed", None), ("prompt.submitted", None)]),
    "stopped": ("interrupted", [("turn.completed", None), ("agent.interrupted", None)]),
    "question": ("awaiting-user", [("tool.started", "q"), ("session.awaiting-user", "q")]),
    "answered": ("completed", [("tool.started", "q"), ("session.awaiting-user", "q"), ("tool.completed", "q"), ("turn.completed", None)]),
    "cut off": ("unknown", [("turn.completed", None), ("command.started", "x")]),
    "permission": ("awaiting-user", [("command.started", "x"), ("command.completed", "x"), ("approval.requested", None)]),
    "permission used": ("completed", [("turn.completed", None), ("approval.requested", None), ("tool.completed", "z")]),
    "error": ("failed", [("turn.completed", None), ("error", None)]),
    "open without id": ("completed", [("turn.completed", None), ("subagent.started", None)]),
    "long ago": ("awaiting-user", [("tool.started", "q"), ("session.awaiting-user", "q"), *[("message", None)] * 300]),
    "nothing": ("unknown", [("session.started", None)]),
}


@pytest.fixture(scope="module")
def statuses(spark):
    rows = [
        (name, i, i, i, kind, call) for name, (_, events) in STORIES.items() for i, (kind, call) in enumerate(events)
    ]
    df = spark.createDataFrame(rows, "session_id string, event_id long, ts_ms long, seq long, event_type string, call_id string")
    return {r["session_id"]: r["status"] for r in session_status(df).collect()}


@pytest.mark.parametrize("name", STORIES)
def test_story(statuses, name):
    assert statuses[name] == STORIES[name][0]


def test_loops_place_outcomes_once(spark):
    """Every rule reads the outcomes that were placed and written, none works them out of the tables anew."""
    d = Domain(spark, "/root/testdata/sf0.001")
    loops = detect.detect_loops(d.sessions, d.threads, d.members, d.patches, d.outcomes, NOW_MS)
    assert loops.inputFiles() and not any("lineitem" in f for f in loops.inputFiles())

"""Collisions: two unrelated sessions on one file, without listing all meetings of their patches.

A result row needs the first meeting of two sessions on a file and what lies within the window around
it. So each file's patches are walked in time order, holding those within the window and the pairs of
sessions that have met; only first meetings leave the walk. A long file is cut into spans that overlap
by the window on both sides, and of a pair's meetings the earliest span's stands.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklake.config import MINUTE, LoopRules
from worklake.operators.ordered import materialize

FILE = ["repo_id", "rel_path"]
#: Patches of a file that one span holds, at least one window's.
SPAN_ROWS = 1_000_000
MET = "repo_id string, rel_path string, session_a string, session_b string, start_ms long, a_ms long, a_id string, b_ms long, b_id string, keys long"


def related_pairs(sessions: DataFrame) -> DataFrame:
    return sessions.select("session_id", "parent_session_id", "started_ms", "last_ms")


def _with_spans(events: DataFrame, window: int, rows: int) -> DataFrame:
    """Events with the span they belong to (`own`) and, beside a border, once more for the neighbouring span."""
    slot = F.floor(F.col("ts_ms") / F.lit(window))
    counts = events.groupBy(*FILE, slot.alias("__slot")).agg(F.count("*").alias("__n"))
    along = Window.partitionBy(*FILE).orderBy("__slot")
    before = F.coalesce(F.sum("__n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = counts.select(*FILE, "__slot", F.floor(before / rows).alias("span"))
    near = lambda move, step: F.when(move("__slot").over(along) == F.col("__slot") + step, move("span").over(along))
    spans = spans.withColumn("__spans", F.array_compact(F.array_distinct(F.array("span", near(F.lag, -1), near(F.lead, 1)))))
    placed = events.withColumn("__slot", slot).join(spans, [*FILE, "__slot"])
    return placed.withColumn("__own", F.col("span")).withColumn("span", F.explode("__spans")).withColumn(
        "own", F.col("span") == F.col("__own")
    )


def _walk_files(window: int):
    """First meetings of two sessions in rows (repo_id, rel_path, span, ts_ms, patch_id, session_id, key, early, late, own) in this order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f.split()[0], pa.int64() if f.endswith("long") else pa.string()) for f in MET.split(", ")])
        place, last, out = None, None, []
        recent, oldest, met, closed, ends = {}, deque(), {}, {}, deque()
        point, fresh = None, []  # early rows of the patch at hand, which others may only follow

        def close(before):
            while ends and (before is None or ends[0][0] < before):
                _, b, a = ends.popleft()
                closed.setdefault(b, set()).add(a)
                out.append((*place[:2], a, b, *met.pop((b, a))))

        for batch in batches:
            for repo, path, span, ts, patch, session, key, early, late, own in zip(*(c.to_pylist() for c in batch.columns)):
                if (repo, path, span) != place:
                    close(None)
                    place = (repo, path, span)
                    recent, oldest, met, closed, ends = {}, deque(), {}, {}, deque()
                    point, fresh = None, []
                if (ts, patch) != point:
                    for k, s in fresh:
                        recent.setdefault(k, {}).setdefault(s, deque()).append(point)
                        oldest.append((point[0], k, s))
                    point, fresh = (ts, patch), []
                close(ts - window)
                while oldest and oldest[0][0] < ts - window:
                    _, k, s = oldest.popleft()
                    recent[k][s].popleft()
                    if not recent[k][s]:
                        del recent[k][s]
                row = (place, ts, patch, session, key, early, late)
                if row == last:
                    continue
                last = row
                if late and key in recent:
                    by = recent[key]
                    for other in by.keys() - closed.get(session, ()):
                        if other == session:
                            continue
                        first, near = by[other][0], by[other][-1]
                        m = met.get((session, other))
                        if m is not None:
                            m[0] = min(m[0], first[0])
                            if (m[3], m[4]) == point and near == (m[1], m[2]):
                                m[5] += 1
                            elif (m[3], m[4]) == point and near > (m[1], m[2]):
                                m[1:3], m[5] = near, 1
                        elif own:
                            met[session, other] = [first[0], *near, ts, patch, 1]
                            ends.append((ts, session, other))
                if early:
                    fresh.append((key, session))
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out.clear()
        close(None)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def first_meetings(events: DataFrame, window: int, rows: int = SPAN_ROWS) -> DataFrame:
    """Per file and two sessions, the first `late` patch at most `window` after an `early` one with the same key.

    `events` are (repo_id, rel_path, key, session_id, ts_ms, patch_id, early, late). `a_ms`, `a_id` is the
    latest early patch before it, `keys` how many keys the two share, `start_ms` the earliest early
    patch that any late one follows within the window.
    """
    known = events.dropna(subset=[*FILE, "key", "session_id", "ts_ms", "patch_id"])
    order = [*FILE, "span", "ts_ms", "patch_id", "session_id", "key", "early", "late", "own"]
    sorted_rows = _with_spans(known, window, rows).select(*order).repartition(*FILE, "span").sortWithinPartitions(*order)
    met = sorted_rows.mapInArrow(_walk_files(window), MET)
    rest = F.struct("start_ms", "a_ms", "b_ms", "keys")
    return met.groupBy(*FILE, "session_a", "session_b").agg(F.min_by(rest, F.struct("b_ms", "b_id")).alias("f")).select(
        *FILE, "session_a", "session_b", "f.*"
    )


def unrelated(pairs: DataFrame, sessions: DataFrame) -> DataFrame:
    """Drops parent/child and sibling pairs; adds both spans (missing ones are unbounded)."""
    side = lambda s: sessions.select(
        F.col("session_id").alias(f"session_{s}"),
        F.col("parent_session_id").alias(f"parent_{s}"),
        F.col("started_ms").alias(f"start_{s}"),
        F.col("last_ms").alias(f"end_{s}"),
    )
    joined = pairs.join(side("a"), "session_a", "left").join(side("b"), "session_b", "left")
    same = lambda x, y: F.coalesce(x == y, F.lit(False))
    rel = (
        same(F.col("parent_a"), F.col("session_b"))
        | same(F.col("parent_b"), F.col("session_a"))
        | same(F.col("parent_a"), F.col("parent_b"))
    )
    return joined.where(~rel)


def spans_overlap() -> Column:
    lo = lambda s: F.coalesce(f"start_{s}", F.lit(-(2**62)))
    hi = lambda s: F.coalesce(f"end_{s}", F.lit(2**62))
    return (lo("a") <= hi("b")) & (lo("b") <= hi("a"))


def overwrites(
    patch_lines: DataFrame, sessions: DataFrame, landed: DataFrame, rules: LoopRules = LoopRules()
) -> DataFrame:
    """A later session removed lines an earlier one had added and not landed.

    `patch_lines` are (repo_id, rel_path, fp, side, session_id, ts_ms, patch_id); `landed` are
    (session_id, rel_path) of files that reached a commit.
    """
    done = landed.select("session_id", "rel_path", F.lit(True).alias("__landed")).distinct()
    lines = patch_lines.dropna(subset=["session_id", "rel_path"]).join(done, ["session_id", "rel_path"], "left")
    early = (F.col("side") == "added") & F.col("__landed").isNull()
    events = lines.select(
        *FILE, F.col("fp").alias("key"), "session_id", "ts_ms", "patch_id", early.alias("early"), (F.col("side") == "removed").alias("late")
    ).where("early or late")
    met = unrelated(first_meetings(events, rules.overwrite_ms), sessions)
    return met.select(
        F.lit("overwrite").alias("kind"), *FILE, "session_a", "session_b", "start_ms",
        F.col("b_ms").alias("end_ms"), F.col("keys").alias("overwritten_lines"),
        F.lit(None).cast("long").alias("minutes_apart"),
    )


def concurrent_edits(
    patches: DataFrame, sessions: DataFrame, rules: LoopRules = LoopRules()
) -> DataFrame:
    """Sessions running at the same time that edited one file within the window."""
    both = [F.lit("").alias("key"), "session_id", "ts_ms", "patch_id", F.lit(True).alias("early"), F.lit(True).alias("late")]
    met = unrelated(first_meetings(patches.select(*FILE, *both), rules.concurrent_ms), sessions).where(spans_overlap())
    return met.select(
        F.lit("concurrent-edit").alias("kind"), *FILE, "session_a", "session_b", "start_ms",
        F.col("b_ms").alias("end_ms"),
        F.lit(None).cast("long").alias("overwritten_lines"),
        F.floor((F.col("b_ms") - F.col("a_ms")) / MINUTE + 0.5).alias("minutes_apart"),
    )


def detect_collisions(
    patches: DataFrame, patch_lines: DataFrame, sessions: DataFrame, landed: DataFrame,
    rules: LoopRules = LoopRules(),
) -> DataFrame:
    """One row per (kind, file, session_a, session_b); an overwrite supersedes a concurrent edit."""
    by_pair = [*FILE, "session_a", "session_b"]
    sessions = materialize(sessions, "sessions")
    over = materialize(overwrites(patch_lines, sessions, landed, rules), "overwrites")
    con = concurrent_edits(patches, sessions, rules).join(over.select(*by_pair), by_pair, "left_anti")
    return over.unionByName(con).withColumn(
        "collision_key", F.concat_ws(":", "kind", "repo_id", "rel_path", "session_a", "session_b")
    )

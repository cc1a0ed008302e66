"""Live-mode operators over whole tables (their streaming runs are in the tests)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklake.bindings import KEY, NOW_MS
from worklake.config import DAY, MINUTE
from worklake.operators.ordered import materialize
from worklake.plans import log_lines
from worklake.plans.log_queries import EVENTS_B
from worklake.plans.match_queries import SQL_COLLISIONS, collision_frames
from worklake.plans.registry import Registry
from worklake.streaming import chunks
from worklake.streaming import live as L


CHUNKED = f"""WITH {EVENTS_B}, c AS (SELECT *, last_value(CASE WHEN t = 'signup' THEN k END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS ctx FROM e)"""


def in_chunks(d):
    """Each rollout cut at two lines of its own into chunks, which are written as they would arrive and read one after another."""
    lines = log_lines.rollouts(d)
    last = d.events.agg(F.max("event_id")).first()[0] or 0
    cut = lambda n: F.pmod(F.xxhash64("file", F.lit(n)), F.lit(3 * last + 3))
    lines = lines.withColumn("chunk", (F.col("ordinal") >= cut(1)).cast("long") + (F.col("ordinal") >= cut(2)).cast("long"))
    written = materialize(lines, "chunk-files", by=("chunk",))
    state = chunks.empty_state(d.spark)
    for n in range(3):
        logs, state = chunks.read_chunks(written.where(F.col("chunk") == n), state, KEY)
        yield logs


def register(q: Registry) -> None:
    @q.add(
        "L01_chunked_events",
        f"""{CHUNKED}, ev AS (
          SELECT session_id, ctx, CASE WHEN t = 'click' THEN CASE WHEN k % 3 = 0 THEN 'command.failed' ELSE 'command.completed' END
            WHEN t = 'view' AND k % 2 = 0 THEN CASE WHEN k % 10 = 0 THEN 'approval.resolved' ELSE 'edit.applied' END
            WHEN t = 'view' THEN CASE WHEN k % 5 = 0 THEN 'tool.failed' ELSE 'tool.completed' END
            WHEN t = 'error' AND k % 2 = 0 THEN 'agent.interrupted' WHEN t = 'error' THEN 'unknown'
            ELSE 'turn.completed' END AS event_type FROM c WHERE t <> 'signup'
          UNION ALL SELECT session_id, ctx, 'edit.applied' FROM c WHERE t = 'view' AND k % 2 = 0 AND k % 10 > 1
          UNION ALL SELECT DISTINCT session_id, CAST(NULL AS BIGINT), 'session.started' FROM e)
        SELECT session_id, event_type, coalesce('/w/u' || (ctx % 3), '/w/start') AS cwd, 'm' || (ctx % 2) AS model, count(*) AS n FROM ev GROUP BY ALL""",
    )
    def _(d):
        parts = [logs.events.select("session_id", "event_type", "cwd", "model") for logs in in_chunks(d)]
        return reduce(DataFrame.unionByName, parts).groupBy("session_id", "event_type", "cwd", "model").agg(F.count("*").alias("n"))

    @q.add(
        "L01_chunked_usage",
        f"""WITH {EVENTS_B}, r AS (SELECT session_id, event_id, ms, v % 4000 AS total, v % 3000 AS i, v % 700 AS c, v % 500 AS o, v % 90 AS r FROM e WHERE t IN ('purchase', 'click')),
        k AS (SELECT *, lag(total) OVER w AS pt FROM r WINDOW w AS (PARTITION BY session_id ORDER BY event_id)),
        kept AS (SELECT * FROM k WHERE pt IS NULL OR pt <> total),
        z AS (SELECT *, lag(total) OVER w AS lt, lag(i) OVER w AS li, lag(c) OVER w AS lc, lag(o) OVER w AS lo, lag(r) OVER w AS lr FROM kept WINDOW w AS (PARTITION BY session_id ORDER BY event_id)),
        dl AS (SELECT session_id, ms, total, CASE WHEN total > lt THEN greatest(0, i - li) ELSE 100 END AS di, CASE WHEN total > lt THEN greatest(0, c - lc) ELSE 10 END AS dc,
            CASE WHEN total > lt THEN greatest(0, o - lo) ELSE 7 END AS dout, CASE WHEN total > lt THEN greatest(0, r - lr) ELSE 1 END AS dr FROM z)
        SELECT session_id, ms AS ts_ms, session_id || ':cum:' || total AS usage_key, greatest(0, di - dc) AS input_tokens, dc AS cached_tokens, dout AS output_tokens, dr AS reasoning_tokens FROM dl""",
    )
    def _(d):
        names = ["session_id", "ts_ms", "usage_key", "input_tokens", "cached_tokens", "output_tokens", "reasoning_tokens"]
        return reduce(DataFrame.unionByName, [logs.usage.select(*names) for logs in in_chunks(d)])

    @q.add(
        "L02_merge_signals",
        "SELECT session_id, event_type, count(*) AS n FROM (SELECT DISTINCT provider, provider_event_type, session_id, event_type, ts_ms, call_id FROM log_events) GROUP BY 1, 2",
    )
    def _(d):
        # The same events delivered by log and by hook, read as one batch.
        ev = d.log_events.select("provider", "provider_event_type", "session_id", "event_type", "ts_ms", "call_id")
        both = L.merge_signals(ev, ev.where("ts_ms % 2 = 0"))
        return both.groupBy("session_id", "event_type").agg(F.count("*").alias("n"))

    span = 700 * DAY
    waiting = f"""SELECT 'awaiting-user:' || session_id || ':' || last_ms AS notice_key, coalesce(title, 'A session') || ' in ' || coalesce(repo_id, 'a repo') || ' needs your answer or approval.' AS message
          FROM sessions WHERE status = 'awaiting-user' AND coalesce(ended_ms, last_ms) >= {NOW_MS - span}"""

    @q.add("L03_awaiting_notices", waiting)
    def _(d):
        return L.awaiting_notices(d.sessions, NOW_MS, span).select("notice_key", "message")

    @q.add(
        "L05_only_new_notices",
        f"SELECT notice_key FROM ({waiting}) WHERE notice_key NOT IN (SELECT 'awaiting-user:' || session_id || ':' || last_ms FROM sessions WHERE last_ms < {NOW_MS - 400 * DAY})",
    )
    def _(d):
        history = L.awaiting_notices(d.sessions.where(F.col("last_ms") < NOW_MS - 400 * DAY), NOW_MS, 10 * span)
        return L.new_notices(L.awaiting_notices(d.sessions, NOW_MS, span), history).select("notice_key")

    open_pairs = SQL_COLLISIONS.replace("lines > 0 AND substring(rel_path, 2, 3) NOT IN ('3', '11') AS over", "lines > 0 AS over")
    end = 996_000_000_000  # within the last days of the table
    @q.add(
        "L04_collision_notices",
        f"""WITH {open_pairs} SELECT 'collision:' || kind || ':' || repo_id || ':' || rel_path || ':' || session_a || ':' || session_b AS notice_key, session_b AS session_id FROM result
          WHERE kind = 'overwrite' OR NOT EXISTS (SELECT 1 FROM result o WHERE o.kind = 'overwrite' AND o.repo_id = result.repo_id AND o.rel_path = result.rel_path AND o.session_a = result.session_a AND o.session_b = result.session_b)""",
    )
    def _(d):
        patches, lines, sessions, _ = collision_frames(d)
        everyone = patches.groupBy("session_id").agg(F.max("ts_ms").alias("__last"))
        full = everyone.join(sessions, "session_id", "left").withColumn("ended_ms", F.col("__last")).drop("__last")
        return L.collision_notices(full, patches, lines, end, end).select("notice_key", "session_id")

    runs = """WITH g AS (SELECT {key} ts_ms, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY {part} ORDER BY ts_ms) < {gap} THEN 0 ELSE 1 END AS s FROM log_events),
        i AS (SELECT *, sum(s) OVER (PARTITION BY {part} ORDER BY ts_ms ROWS UNBOUNDED PRECEDING) AS run FROM g)
        SELECT {key} min(ts_ms) AS start_ms, max(ts_ms) + {gap} AS end_ms, count(*) AS events FROM i GROUP BY {key} run"""

    @q.add("L06_quiet_signals", runs.format(key="", part="1", gap=120_000))
    def _(d):
        rows = d.log_events.withColumn("all", F.lit(1))
        return L.activity_windows(rows, ["all"], 2 * MINUTE).drop("all")

    @q.add("L07_running_sessions", runs.format(key="session_id,", part="session_id", gap=600_000))
    def _(d):
        return L.activity_windows(d.log_events, ["session_id"], 10 * MINUTE)

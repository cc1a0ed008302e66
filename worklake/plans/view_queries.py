"""Session state, detectors, stored-snapshot syncs and read models."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklake.bindings import NOW_MS, Domain
from worklake.config import DAY, MINUTE
from worklake.functions.text import agent_name
from worklake.operators import detect as D
from worklake.operators import ingest as I
from worklake.operators import matching as M
from worklake.operators import search as R
from worklake.operators import sessions as S
from worklake.operators import sync as Y
from worklake.operators import threads as T
from worklake.operators import validate as N
from worklake.operators.collisions import detect_collisions
from worklake.operators.ordered import checkpoint_dir, materialize
from worklake.plans import views as V
from worklake.plans.match_queries import SELF_CHECK, SQL_COLLISIONS, collision_frames, main_branches, patch_frames
from worklake.plans.registry import Registry

FROM_MS, TO_MS = 946_684_800_000, 978_307_200_000  # the year 2000
DAY_FROM, DAY_TO = 962_409_600_000, 962_409_600_000 + 3 * DAY
AGENT = "CASE provider WHEN 'codex' THEN 'Codex' ELSE 'Claude Code' END"
RUNNING = """NOT (ended_ms IS NOT NULL AND ended_ms >= last_ms) AND {now} - last_ms < 600000 AND status NOT IN ('failed', 'interrupted')"""
KNOWN_COUNTS = "count(*) FILTER (class = 'landed') AS landed, count(*) FILTER (class = 'uncommitted') AS uncommitted, count(*) FILTER (class = 'partial') AS partial, count(*) FILTER (class = 'lost') AS lost"


def register(q: Registry) -> None:
    register_sessions(q)
    register_detectors(q)
    register_storage(q)
    register_views(q)


def register_sessions(q: Registry) -> None:
    @q.add(
        "A06_session_aggregates",
        """SELECT session_id, count(*) AS event_count, count(*) FILTER (status = 'failure') AS failure_count, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms,
          count(DISTINCT file_path) AS changed_files FROM log_events GROUP BY 1""",
    )
    def _(d):
        files = S.changed_files(d.log_events.where("file_path is not null").withColumnRenamed("file_path", "path"))
        return S.event_counts(d.log_events).join(files, "session_id", "left").fillna({"changed_files": 0})

    @q.add(
        "A10_outcome_summary",
        "SELECT session_id, string_agg(class || '=' || n, ',' ORDER BY class) AS summary FROM (SELECT session_id, class, count(*) AS n FROM outcomes GROUP BY 1, 2) GROUP BY 1",
    )
    def _(d):
        m = S.outcome_summary(d.outcomes)
        pairs = F.transform(F.map_entries("outcome_summary"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
        return m.select("session_id", F.array_join(pairs, ",").alias("summary"))

    groups = """SELECT session_id, coalesce(display, tool_name, event_type) AS signature, count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms
          FROM log_events WHERE event_type IN ('command.failed', 'tool.failed') GROUP BY 1, 2"""

    @q.add("A11_failure_groups", f"{groups} HAVING count(*) >= 3")
    def _(d):
        return S.failure_groups(d.log_events, 3)

    @q.add(
        "W02_latest_events",
        """SELECT session_id, event_id, rn FROM (SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms DESC, seq DESC, event_id DESC) AS rn FROM log_events) WHERE rn <= 10""",
    )
    def _(d):
        return S.latest_events(d.log_events, 10).select("session_id", "event_id", "rn")

    @q.add(
        "W03_session_status",
        """WITH n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms DESC, seq DESC, event_id DESC) AS rn FROM log_events),
        l AS (SELECT * FROM n), fin AS (SELECT * FROM l WHERE event_type IN ('tool.completed', 'tool.failed', 'command.completed', 'command.failed', 'subagent.ended', 'approval.resolved')),
        j AS (SELECT l.*, EXISTS (SELECT 1 FROM fin f WHERE f.session_id = l.session_id AND f.call_id = l.call_id AND f.rn < l.rn) AS closed,
            EXISTS (SELECT 1 FROM fin f WHERE f.session_id = l.session_id AND f.rn < l.rn) AS moved_on,
            EXISTS (SELECT 1 FROM l a WHERE a.session_id = l.session_id AND a.call_id = l.call_id AND a.event_type = 'session.awaiting-user') AS asks FROM l),
        dec AS (SELECT session_id, rn, CASE WHEN event_type = 'agent.interrupted' THEN 'interrupted'
            WHEN event_type IN ('tool.started', 'command.started', 'subagent.started') THEN CASE WHEN call_id IS NOT NULL AND NOT closed THEN CASE WHEN asks THEN 'awaiting-user' ELSE 'unknown' END END
            WHEN event_type = 'approval.requested' THEN CASE WHEN NOT moved_on AND NOT (call_id IS NOT NULL AND closed) THEN 'awaiting-user' END
            WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'turn.completed' THEN 'completed' WHEN event_type = 'prompt.submitted' THEN 'unknown' END AS v FROM j)
        SELECT session_id, coalesce(arg_min(v, rn) FILTER (v IS NOT NULL), 'unknown') AS status FROM dec GROUP BY 1""",
    )
    def _(d):
        return S.session_status(d.log_events)

    @q.add(
        "W04_session_end",
        """SELECT session_id, CASE WHEN max(ts_ms) FILTER (event_type = 'session.ended') >= max(ts_ms) THEN max(ts_ms) FILTER (event_type = 'session.ended') END AS ended_ms FROM log_events GROUP BY 1""",
    )
    def _(d):
        return S.session_end(d.log_events)

    @q.add(
        "W05_timeline",
        """WITH shown AS (SELECT user_key AS session_id, ts_ms, seq, event_id, event_type, status, coalesce(display, file_path, error_code) AS detail,
            CASE WHEN event_type = 'prompt.submitted' THEN 'Prompt' WHEN event_type = 'turn.completed' THEN 'Turn completed'
              WHEN event_type IN ('command.completed', 'command.failed') THEN coalesce(executable, 'Command')
              WHEN event_type = 'edit.applied' THEN CASE file_operation WHEN 'create' THEN 'Created file' ELSE 'Edited file' END
              WHEN event_type = 'tool.completed' THEN coalesce(tool_name, 'Tool') WHEN event_type = 'agent.interrupted' THEN 'Interrupted'
              WHEN event_type = 'session.awaiting-user' THEN 'Asked you a question' WHEN event_type = 'error' THEN 'Error' ELSE provider_event_type END AS label
          FROM log_events WHERE event_type NOT LIKE '%.started'),
        g AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type AND lag(label) OVER w = label AND event_type NOT IN ('prompt.submitted', 'turn.completed') THEN 0 ELSE 1 END AS s
          FROM shown WINDOW w AS (PARTITION BY session_id ORDER BY ts_ms, seq, event_id)),
        i AS (SELECT *, sum(s) OVER (PARTITION BY session_id ORDER BY ts_ms, seq, event_id) AS island FROM g)
        SELECT session_id, min(ts_ms) AS at_ms, arg_min(event_id, (ts_ms, seq, event_id)) AS event_id, arg_min(event_type, (ts_ms, seq, event_id)) AS event_type, arg_min(label, (ts_ms, seq, event_id)) AS label,
          CASE WHEN count(*) = 1 THEN max(detail) END AS detail, count(*) AS count FROM i GROUP BY session_id, island""",
    )
    def _(d):
        ev = d.log_events.drop("session_id").withColumnRenamed("user_key", "session_id")
        return S.timeline(ev).drop("seq", "status")

    @q.add(
        "W06_first_edits",
        "SELECT session_id, rel_path, min(ts_ms) AS first_edit_ms FROM patches GROUP BY 1, 2",
    )
    def _(d):
        return D.first_edits(d.patches)

    @q.add(
        "W07_work_branches",
        """WITH u AS (SELECT session_id, repo_id, started_ms, last_ms, unnest([git_branch_start, git_branch_end]) AS branch FROM sessions WHERE repo_id IS NOT NULL)
        SELECT DISTINCT u.session_id, u.branch FROM u JOIN (SELECT repo_id, branch FROM u WHERE branch IS NOT NULL AND branch <> 'main' GROUP BY 1, 2 HAVING max(last_ms) - min(started_ms) <= 1209600000) s
          ON s.repo_id = u.repo_id AND s.branch = u.branch""",
    )
    def _(d):
        base = d.sessions.where("repo_id is not null")
        return T.work_branches(base, main_branches(d)).select("session_id", "branch")

    @q.add(
        "W10_list_events",
        """SELECT event_id, ts_ms, event_type FROM log_events WHERE ts_ms >= 1704500000000 AND ts_ms < 1705500000000 AND event_type IN ('error', 'turn.completed') ORDER BY ts_ms, seq, event_id LIMIT 200""",
    )
    def _(d):
        return S.list_events(d.log_events, 1_704_500_000_000, 1_705_500_000_000, ["error", "turn.completed"], 200).select(
            "event_id", "ts_ms", "event_type"
        )

    @q.add(
        "G09_merge_sessions",
        """WITH f AS (SELECT user_key AS session_id, k AS pass, ts_ms, event_id, CASE WHEN k % 3 = 0 THEN '/w/' || (tokens % 5) END AS cwd, CASE WHEN k % 4 = 0 THEN 'b' || (tokens % 7) END AS branch,
            CASE WHEN k % 5 = 0 THEN 'T' || tokens END AS title, k % 10 = 0 AS obs FROM log_events)
        SELECT session_id, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, arg_min(cwd, event_id) FILTER (cwd IS NOT NULL) AS cwd, arg_min(branch, event_id) FILTER (branch IS NOT NULL) AS branch_start,
          arg_max(branch, (ts_ms, event_id)) FILTER (branch IS NOT NULL) AS branch_end, arg_max(title, (obs, event_id)) FILTER (title IS NOT NULL) AS title,
          CASE WHEN bool_or(obs) FILTER (title IS NOT NULL) THEN 'observed' WHEN count(title) > 0 THEN 'generated' END AS title_provenance FROM f GROUP BY 1""",
    )
    def _(d):
        k = F.col("k")
        branch = F.when(k % 4 == 0, F.concat(F.lit("b"), F.col("tokens") % 7))
        facts = d.log_events.select(
            "provider", F.col("user_key").alias("session_id"), F.col("event_id").alias("pass_no"),
            F.col("ts_ms").alias("first_ms"), F.col("ts_ms").alias("last_ms"),
            F.when(k % 3 == 0, F.concat(F.lit("/w/"), F.col("tokens") % 5)).alias("cwd"),
            F.lit(None).cast("string").alias("parent_session_id"),
            branch.alias("branch_first"), branch.alias("branch_last"), F.lit("m").alias("model"),
            F.when(k % 5 == 0, F.concat(F.lit("T"), "tokens")).alias("title"),
            F.when(k % 10 == 0, "observed").otherwise("generated").alias("title_provenance"),
        )
        return S.merge_sessions(facts).drop("provider", "parent_session_id", "model")

    @q.add(
        "D10_running_sessions",
        f"SELECT session_id FROM sessions WHERE {RUNNING.format(now='last_ms + (event_count - 30) * 60000')}",
    )
    def _(d):
        # Every session seen from its own clock: the last event minus a shift that spreads them.
        shifted = d.sessions.withColumn("shift", (F.col("event_count") - 30) * MINUTE)
        rows = shifted.select("session_id", "status", "ended_ms", "last_ms", "shift")
        moved = rows.select(
            "session_id", "status",
            (F.col("ended_ms") - F.col("last_ms") - F.col("shift")).alias("ended_ms"),
            (-F.col("shift")).alias("last_ms"),
        )
        return moved.where(S.is_running(0)).select("session_id")

    @q.add(
        "J18_fold_subagents",
        """SELECT s.session_id, CASE WHEN p.session_id IS NOT NULL THEN p.session_id ELSE s.session_id END AS root_session_id FROM sessions s
          LEFT JOIN sessions p ON p.session_id = s.parent_session_id""",
    )
    def _(d):
        return S.fold_subagents(d.sessions).select("session_id", "root_session_id")


FOUND = """
    lo AS (SELECT o.*, m.thread_id, coalesce(m.thread_id, o.session_id) AS group_key, coalesce(e.first_edit_ms, computed_ms) AS since_ms FROM outcomes o
      LEFT JOIN members m USING (session_id) LEFT JOIN (SELECT session_id, rel_path, min(ts_ms) AS first_edit_ms FROM patches GROUP BY 1, 2) e USING (session_id, rel_path)
      WHERE o.rel_path NOT LIKE 'output/%' AND o.rel_path NOT LIKE '.planning/%')"""
LATER = """
    ls AS (SELECT s.*, m.thread_id, EXISTS (SELECT 1 FROM members a JOIN sessions o USING (session_id) WHERE a.thread_id = m.thread_id AND o.session_id <> s.session_id AND o.started_ms > s.last_ms) AS later,
        EXISTS (SELECT 1 FROM members a JOIN sessions o USING (session_id) JOIN outcomes x ON x.session_id = o.session_id AND x.class = 'landed'
          WHERE a.thread_id = m.thread_id AND o.session_id <> s.session_id AND o.started_ms > s.last_ms) AS later_landed
      FROM sessions s LEFT JOIN members m USING (session_id))"""


def found(d: Domain):
    return D.loop_outcomes(d.outcomes, d.patches, d.members)


def register_detectors(q: Registry) -> None:
    @q.add(
        "D01_uncommitted_output",
        f"WITH {FOUND} SELECT 'uncommitted-output:' || group_key AS loop_key, min(since_ms) AS since_ms, count(*) AS files, CAST(sum(line_count) AS BIGINT) AS lines, count(DISTINCT session_id) AS sessions FROM lo WHERE class = 'uncommitted' GROUP BY group_key HAVING {NOW_MS} - min(since_ms) >= 86400000 AND sum(line_count) >= 10",
    )
    def _(d):
        return D.uncommitted_output(found(d), NOW_MS).select("loop_key", "since_ms", "files", "lines", "sessions")

    @q.add(
        "D02_unmerged_branch",
        f"""WITH {FOUND}, b AS (SELECT lo.*, s.last_ms, coalesce(first_branch, git_branch_end, git_branch_start, t.branch) AS br FROM lo LEFT JOIN sessions s USING (session_id)
          LEFT JOIN threads t ON t.thread_id = lo.thread_id WHERE class = 'landed' AND frac_on_default = 0)
        SELECT 'unmerged-agent-branch:' || repo_id || ':' || coalesce(br, 'thread:' || group_key) AS loop_key, max(br) AS branch, min(since_ms) AS since_ms, count(*) AS files, CAST(sum(line_count) AS BIGINT) AS lines,
          count(DISTINCT first_sha) AS commits, count(DISTINCT session_id) AS sessions FROM b GROUP BY repo_id, coalesce(br, 'thread:' || group_key) HAVING {NOW_MS} - max(last_ms) >= 604800000 AND sum(line_count) >= 10""",
    )
    def _(d):
        return D.unmerged_branch(found(d), d.sessions, d.threads, NOW_MS).select(
            "loop_key", "branch", "since_ms", "files", "lines", "commits", "sessions"
        )

    @q.add(
        "D03_lost_work",
        f"WITH {FOUND} SELECT 'lost-work:' || group_key AS loop_key, min(since_ms) AS since_ms, count(*) AS files, CAST(sum(line_count) AS BIGINT) AS lines FROM lo WHERE class IN ('lost', 'landed') GROUP BY group_key HAVING NOT bool_or(class = 'landed') AND sum(line_count) >= 20",
    )
    def _(d):
        return D.lost_work(found(d)).select("loop_key", "since_ms", "files", "lines")

    @q.add(
        "D04_J14_awaiting_user",
        f"WITH {LATER} SELECT 'awaiting-user:' || session_id AS loop_key, last_ms AS since_ms, thread_id FROM ls WHERE status = 'awaiting-user' AND NOT later AND {NOW_MS} - last_ms >= 1800000",
    )
    def _(d):
        landed = d.outcomes.where("class = 'landed'")
        return D.awaiting_user(d.sessions, d.members, landed, NOW_MS).select("loop_key", "since_ms", "thread_id")

    @q.add(
        "D05_J14_failed_unresolved",
        f"WITH {LATER} SELECT 'failed-unresolved:' || session_id AS loop_key, last_ms AS since_ms, status FROM ls WHERE status IN ('failed', 'interrupted') AND parent_session_id IS NULL AND NOT later_landed AND {NOW_MS} - last_ms >= 3600000",
    )
    def _(d):
        landed = d.outcomes.where("class = 'landed'")
        return D.failed_unresolved(d.sessions, d.members, landed, NOW_MS).select("loop_key", "since_ms", "status")

    @q.add(
        "D01_D05_all_loops_by_type",
        f"""WITH {FOUND}, {LATER}, k AS (
          SELECT 'uncommitted-output' AS type FROM lo WHERE class = 'uncommitted' GROUP BY group_key HAVING {NOW_MS} - min(since_ms) >= 86400000 AND sum(line_count) >= 10
          UNION ALL SELECT 'lost-work' FROM lo WHERE class IN ('lost', 'landed') GROUP BY group_key HAVING NOT bool_or(class = 'landed') AND sum(line_count) >= 20
          UNION ALL SELECT 'unmerged-agent-branch' FROM (SELECT lo.*, s.last_ms, coalesce(first_branch, git_branch_end, git_branch_start, t.branch, 'thread:' || group_key) AS br FROM lo LEFT JOIN sessions s USING (session_id)
            LEFT JOIN threads t ON t.thread_id = lo.thread_id WHERE class = 'landed' AND frac_on_default = 0) GROUP BY repo_id, br HAVING {NOW_MS} - max(last_ms) >= 604800000 AND sum(line_count) >= 10
          UNION ALL SELECT 'awaiting-user' FROM ls WHERE status = 'awaiting-user' AND NOT later AND {NOW_MS} - last_ms >= 1800000
          UNION ALL SELECT 'failed-unresolved' FROM ls WHERE status IN ('failed', 'interrupted') AND parent_session_id IS NULL AND NOT later_landed AND {NOW_MS} - last_ms >= 3600000)
        SELECT type, count(*) AS n FROM k GROUP BY 1""",
    )
    def _(d):
        loops = D.detect_loops(d.sessions, d.threads, d.members, d.patches, d.outcomes, NOW_MS)
        return loops.groupBy("type").agg(F.count("*").alias("n"))

    groups = """g AS (SELECT session_id, coalesce(display, tool_name, event_type) AS signature, count(*) AS n, max(ts_ms) AS last_ms
          FROM log_events WHERE event_type IN ('command.failed', 'tool.failed') GROUP BY 1, 2 HAVING count(*) >= 3)"""

    @q.add(
        "D07_repeated_failures",
        f"""WITH RECURSIVE {groups}, f(t, i, h) AS (SELECT DISTINCT signature, 0, CAST(2166136261 AS BIGINT) FROM g
          UNION ALL SELECT t, i + 1, (xor(h, CAST(unicode(substring(t, i + 1, 1)) AS BIGINT)) * 16777619) & 4294967295 FROM f WHERE i < length(t))
        SELECT session_id, h, '`' || signature || '` failed ' || n || ' times in one session' AS message, last_ms AS created_ms FROM g JOIN f ON t = signature AND i = length(t)""",
        recursive=True,
    )
    def _(d):
        rows = D.repeated_failures(S.failure_groups(d.log_events, 1))
        h = F.conv(F.element_at(F.split("insight_key", ":"), -1), 36, 10).cast("bigint")
        return rows.select("session_id", h.alias("h"), "message", "created_ms")

    @q.add(
        "D08_broken_sessions",
        """SELECT status || '-session:' || session_id AS insight_key, CASE status WHEN 'failed' THEN 'warning' ELSE 'info' END AS severity, last_ms AS created_ms
          FROM sessions WHERE status IN ('failed', 'interrupted') AND parent_session_id IS NULL""",
    )
    def _(d):
        return D.broken_sessions(d.sessions).select("insight_key", "severity", "created_ms")

    @q.add(
        "D09_idle_tokens",
        """SELECT session_id FROM sessions JOIN (SELECT session_id FROM outcomes WHERE class <> 'unknown' GROUP BY 1 HAVING bool_and(class IN ('lost', 'uncommitted'))) USING (session_id)
          WHERE coalesce(input_tokens, 0) + coalesce(output_tokens, 0) >= 200000""",
    )
    def _(d):
        return D.idle_tokens(d.sessions, d.outcomes).select("session_id")

    @q.add(
        "D11_loop_descriptions",
        """SELECT loop_key, 'Agent work that was lost in n' || repo_id || ' (' || files || ' files, ' || lines || ' lines)' AS description FROM loops""",
    )
    def _(d):
        rows = d.loops.withColumn("repo", F.concat(F.lit("n"), "repo_id")).withColumn("status", F.lit(None).cast("string"))
        return D.describe_loops(rows).select("loop_key", "description")

    @q.add(
        "G02_G03_W09_thread_rollup",
        f"""WITH s AS (SELECT s.*, m.thread_id, coalesce(git_branch_end, git_branch_start) AS br FROM sessions s JOIN members m USING (session_id) WHERE repo_id IS NOT NULL),
        u AS (SELECT session_id, repo_id, started_ms, last_ms, unnest([git_branch_start, git_branch_end]) AS branch FROM sessions WHERE repo_id IS NOT NULL),
        wb AS (SELECT DISTINCT u.session_id, u.branch FROM u JOIN (SELECT repo_id, branch FROM u WHERE branch IS NOT NULL AND branch <> 'main' GROUP BY 1, 2 HAVING max(last_ms) - min(started_ms) <= 1209600000) k
          ON k.repo_id = u.repo_id AND k.branch = u.branch),
        a AS (SELECT thread_id, count(*) AS sessions, string_agg(DISTINCT provider, ',' ORDER BY provider) AS providers, min(started_ms) AS started_ms, max(last_ms) AS last_ms,
            arg_max(br, (-started_ms, session_id)) FILTER ((session_id, br) IN (SELECT (session_id, branch) FROM wb)) AS branch,
            arg_max(title, (-started_ms, session_id)) FILTER (title_provenance = 'observed') AS t1, arg_max(title, (-started_ms, session_id)) FILTER (title IS NOT NULL) AS t2,
            arg_max(br, (-started_ms, session_id)) FILTER (br IS NOT NULL AND br <> 'HEAD') AS any_branch FROM s GROUP BY 1),
        o AS (SELECT thread_id, bool_or(class IN ('uncommitted', 'partial')) AS op, bool_or(class = 'landed') AS la, bool_or(class = 'lost') AS lo,
            arg_min(first_subject, (first_commit_ms, first_subject)) FILTER (first_subject IS NOT NULL) AS subject FROM outcomes JOIN members USING (session_id) GROUP BY 1),
        dd AS (SELECT thread_id, CASE WHEN len(string_split(rel_path, '/')) > 1 THEN array_to_string(string_split(rel_path, '/')[1:least(2, len(string_split(rel_path, '/')) - 1)], '/') ELSE rel_path END AS dir, count(*) AS n
          FROM (SELECT DISTINCT session_id, rel_path FROM patches) JOIN members USING (session_id) GROUP BY 1, 2),
        td AS (SELECT thread_id, arg_min(dir, (-n, dir)) AS dir FROM dd GROUP BY 1)
        SELECT a.thread_id, sessions, providers, started_ms, last_ms, branch,
          CASE WHEN branch IS NOT NULL THEN coalesce(nullif(trim(regexp_replace(regexp_replace(branch, '(?i)^(?:feature|feat|fix|bugfix|chore|refactor|codex|claude|agent|wip)[/_-]', ''), '[/_-]+', ' ', 'g')), ''), branch)
            ELSE coalesce(subject, t1, t2, 'Work in ' || dir,
              replace(replace(replace(providers, 'claude-code', 'Claude Code'), 'codex', 'Codex'), ',', ' + ') || CASE WHEN sessions > 1 THEN ' sessions' ELSE ' session' END || coalesce(' on ' || any_branch, '') || ' (no edits)') END AS title,
          CASE WHEN branch IS NOT NULL OR subject IS NOT NULL OR t1 IS NOT NULL THEN 'observed' WHEN t2 IS NOT NULL THEN 'generated' ELSE 'derived' END AS title_provenance,
          CASE WHEN {NOW_MS} - last_ms <= 7200000 THEN 'active' WHEN op THEN 'dangling' WHEN la THEN 'landed' WHEN lo AND {NOW_MS} - last_ms > 1209600000 THEN 'abandoned' ELSE 'unknown' END AS status
        FROM a LEFT JOIN o USING (thread_id) LEFT JOIN td USING (thread_id)""",
    )
    def _(d):
        base = d.sessions.where("repo_id is not null")
        wb = T.work_branches(base, main_branches(d))
        return T.roll_up(d.members, base, d.patches, d.outcomes, wb, NOW_MS).drop("repo_id")

    @q.add(
        "N20_invariants",
        """SELECT 'title-without-provenance' AS rule, 0 AS n UNION ALL SELECT 'status', 0 UNION ALL SELECT 'ended-before-start', 0 UNION ALL SELECT 'last-before-start', 0
          UNION ALL SELECT 'more-failures-than-events', (SELECT count(*) FROM sessions WHERE failure_count > event_count)
          UNION ALL SELECT 'landed-needs-commit', 0 UNION ALL SELECT 'class', 0 UNION ALL SELECT 'patch-scope-needs-patch', 0 UNION ALL SELECT 'survival-only-landed', 0 UNION ALL SELECT 'lag-needs-commit', 0
          UNION ALL SELECT 'reason-iff-unknown', (SELECT count(*) FROM outcomes WHERE class = 'unknown')
          UNION ALL SELECT 'default-above-committed', (SELECT count(*) FROM outcomes WHERE frac_on_default > 0.5)
          UNION ALL SELECT 'instant-shape', (SELECT count(*) FROM orders WHERE o_orderkey % 9 = 0)
          UNION ALL SELECT 'instant-calendar', (SELECT count(*) FROM orders WHERE o_orderkey % 9 = 1)""".replace(", 0 AS n", ", CAST(0 AS BIGINT) AS n"),
    )
    def _(d):
        outs = d.outcomes.withColumn("scope", F.lit("session-file")).withColumn("patch_id", F.lit(None).cast("string"))
        outs = outs.withColumn("unknown_reason", F.lit(None).cast("string")).withColumn("frac_committed", F.lit(0.5))
        k = F.col("o_orderkey") % 9
        stamps = d.orders.select(
            F.when(k == 0, "2024-01-01T00:00:00").when(k == 1, "2023-02-29T10:00:00Z").otherwise("2024-02-29T10:00:00.123+02:00").alias("at")
        )
        return (
            N.violation_counts(d.sessions, N.session_rules())
            .unionByName(N.violation_counts(outs, N.outcome_rules()))
            .unionByName(N.violation_counts(stamps, N.instant_rules("at")))
        )

    @q.add(
        "N20_more_invariants",
        """SELECT 'event-type' AS rule, CAST(0 AS BIGINT) AS n
          UNION ALL SELECT 'prompt-not-declared', (SELECT count(*) FROM log_events WHERE event_type = 'prompt.submitted' AND k % 3 > 0)
          UNION ALL SELECT 'arguments-not-declared', (SELECT count(*) FROM log_events WHERE display IS NOT NULL AND status = 'failure')
          UNION ALL SELECT 'result-not-declared', (SELECT count(*) FROM log_events WHERE status = 'failure')
          UNION ALL SELECT 'rel-path-needs-repo', (SELECT count(DISTINCT patch_id) FROM patch_lines WHERE repo_id IS NULL)
          UNION ALL SELECT 'rel-path-shape', (SELECT count(DISTINCT patch_id) FROM patch_lines WHERE rel_path LIKE 'docs/%')
          UNION ALL SELECT 'more-added-than-raw', (SELECT count(*) FROM (SELECT patch_id FROM patch_lines WHERE side = 'added' GROUP BY 1 HAVING count(*) > 2))
          UNION ALL SELECT 'more-removed-than-raw', 0 UNION ALL SELECT 'fingerprint-shape', (SELECT count(DISTINCT patch_id) FROM patch_lines WHERE fp LIKE '%f')
          UNION ALL SELECT 'last-before-start', 0
          UNION ALL SELECT 'links-missing', (SELECT count(*) FROM threads WHERE sessions > 1 AND branch IS NULL)
          UNION ALL SELECT 'foreign-link', (SELECT count(*) FROM threads WHERE status = 'dangling')
          UNION ALL SELECT 'resolved-by-needs-resolved', (SELECT count(*) FROM loops WHERE state <> 'resolved' AND files > 1)
          UNION ALL SELECT 'awaiting-is-inferred', (SELECT count(*) FROM loops WHERE lines % 7 = 0 AND lines % 2 = 0)
          UNION ALL SELECT 'two-sessions', (SELECT count(*) FROM sessions WHERE repo_id IS NULL)
          UNION ALL SELECT 'window-order', (SELECT count(*) FROM sessions WHERE ended_ms < last_ms - 1 OR ended_ms IS NULL)
          UNION ALL SELECT 'duplicate-is-inferred', (SELECT count(*) FROM sessions WHERE status = 'failed' AND title IS NOT NULL)""",
    )
    def _(d):
        failed = F.col("status") == "failure"
        ev = d.log_events.select(
            "event_type", F.when(F.col("event_type") == "prompt.submitted", "hi").alias("prompt"), (F.col("k") % 3 == 0).alias("prompt_captured"),
            F.col("display").alias("tool_arguments"), (F.col("status") == "success").alias("arguments_captured"),
            F.when(failed, "out").alias("tool_result"), F.lit(False).alias("result_captured"),
        )
        fps = lambda side: F.collect_list(F.when(F.col("side") == side, F.regexp_replace("fp", "f$", "F")))
        patches = d.patch_lines.groupBy("patch_id", "repo_id", "rel_path").agg(
            fps("added").alias("added_fps"), fps("removed").alias("removed_fps")
        ).select(
            "repo_id", F.regexp_replace("rel_path", "^docs/", "docs/../").alias("rel_path"), "added_fps", "removed_fps",
            F.least(F.size("added_fps"), F.lit(2)).alias("added_raw"), F.size("removed_fps").alias("removed_raw"),
        )
        threads = d.threads.select(
            "started_ms", "last_ms", "sessions", F.when(F.col("branch").isNull(), 0).otherwise(F.col("sessions") - 1).alias("links"),
            (F.col("status") == "dangling").cast("int").alias("foreign_links"),
        )
        loops = d.loops.select(
            "state", F.when((F.col("state") == "resolved") | (F.col("files") > 1), "user").alias("resolved_by"),
            F.when(F.col("lines") % 7 == 0, "awaiting-user").otherwise(F.col("type")).alias("type"),
            F.when(F.col("lines") % 2 == 0, "derived").otherwise("inferred").alias("provenance"),
        )
        pairs = d.sessions.select(
            F.col("session_id").alias("session_a"), F.when(F.col("repo_id").isNull(), F.col("session_id")).otherwise("other").alias("session_b"),
            F.col("last_ms").alias("start_ms"), F.coalesce("ended_ms", F.col("last_ms") - 1).alias("end_ms"),
            F.when(F.col("status") == "failed", "possible-duplicate").otherwise("overwrite").alias("kind"),
            F.when(F.col("title").isNull(), "inferred").otherwise("derived").alias("provenance"),
        )
        frames = (
            (ev, N.event_rules()), (patches, N.patch_rules()), (threads, N.thread_rules()), (loops, N.loop_rules()), (pairs, N.collision_rules()),
        )
        out = [N.violation_counts(*f) for f in frames]
        return reduce(DataFrame.unionByName, out)

    @q.add(
        "N20_broken_sessions",
        "SELECT session_id, 'more-failures-than-events' AS broken FROM sessions WHERE failure_count > event_count",
    )
    def _(d):
        return N.violations(d.sessions, N.session_rules()).select("session_id", "broken")


def register_storage(q: Registry) -> None:
    sync_sql = f"""WITH stored AS (SELECT * FROM loops WHERE length(loop_key) % 3 > 0), det AS (SELECT loop_key, lines + 1 AS lines FROM loops WHERE length(loop_key) % 4 > 0)
        SELECT coalesce(s.loop_key, n.loop_key) AS loop_key, CASE WHEN n.loop_key IS NOT NULL THEN n.lines ELSE s.lines END AS lines,
          CASE WHEN s.loop_key IS NULL THEN 'opened' WHEN n.loop_key IS NOT NULL AND state = 'resolved' THEN 'reopened' WHEN n.loop_key IS NOT NULL THEN 'updated' WHEN state = 'open' THEN 'resolved' ELSE 'kept' END AS change,
          CASE WHEN s.loop_key IS NULL THEN 'open' WHEN n.loop_key IS NOT NULL AND state = 'resolved' THEN 'open' WHEN n.loop_key IS NULL AND state = 'open' THEN 'resolved' ELSE state END AS state,
          CASE WHEN s.loop_key IS NULL OR (n.loop_key IS NOT NULL AND state = 'resolved') THEN NULL WHEN n.loop_key IS NULL AND state = 'open' THEN 'auto' ELSE resolved_by END AS resolved_by
        FROM stored s FULL JOIN det n ON s.loop_key = n.loop_key"""

    def synced(d):
        stored = d.loops.where("length(loop_key) % 3 > 0").select("loop_key", "lines", "state", "resolved_by")
        det = d.loops.where("length(loop_key) % 4 > 0").select("loop_key", (F.col("lines") + 1).alias("lines"))
        return Y.sync_loops(stored, det, NOW_MS)

    @q.add("S07_replace_derived", "SELECT loop_key, lines, state FROM loops")
    def _(d):
        # The second version is made from the first, with a repeat of every key.
        path = f"{checkpoint_dir(d.spark)}/loops-{uuid.uuid4().hex}"
        Y.replace_all(d.loops.select("loop_key", "lines", "state"), ["loop_key"], path)
        stored = Y.current(d.spark, path)
        Y.replace_all(stored.unionByName(stored.withColumn("lines", F.col("lines") + 1)), ["loop_key"], path)
        return Y.current(d.spark, path)

    @q.add("S05_sync_loops", sync_sql)
    def _(d):
        return synced(d).drop("synced_ms")

    @q.add(
        "S05_sync_report",
        f"SELECT count(*) FILTER (change = 'opened') AS opened, count(*) FILTER (change = 'resolved') AS resolved FROM ({sync_sql})",
    )
    def _(d):
        return Y.sync_report(synced(d))

    @q.add(
        "Q06_loop_actions",
        """SELECT loop_key, CASE lines % 4 WHEN 0 THEN 'dismissed' WHEN 1 THEN 'resolved' WHEN 2 THEN 'open' ELSE state END AS state,
          CASE lines % 4 WHEN 1 THEN 'user' WHEN 3 THEN resolved_by END AS resolved_by, CASE WHEN lines % 4 = 0 THEN 'not needed' END AS dismiss_reason FROM loops""",
    )
    def _(d):
        m = F.col("lines") % 4
        act = d.loops.where(m < 3).select(
            "loop_key", F.when(m == 0, "dismissed").when(m == 1, "resolved").otherwise("open").alias("action"),
            F.lit("not needed").alias("reason"),
        )
        return Y.set_loop_state(d.loops, act).select("loop_key", "state", "resolved_by", "dismiss_reason")

    @q.add(
        "S06_sync_insights",
        """WITH st AS (SELECT loop_key AS k, lines, CASE WHEN lines % 3 = 0 THEN 5 END AS dis FROM loops WHERE lines % 2 = 0), n AS (SELECT loop_key AS k, lines + 7 AS lines FROM loops WHERE files + lines % 5 > 3)
        SELECT coalesce(st.k, n.k) AS insight_key, coalesce(n.lines, st.lines) AS lines, CAST(dis AS BIGINT) AS dismissed_ms FROM st FULL JOIN n ON st.k = n.k WHERE n.k IS NOT NULL OR dis IS NOT NULL""",
    )
    def _(d):
        base = d.loops.select(F.col("loop_key").alias("insight_key"), "lines", "files", F.lit(1).alias("created_ms"))
        stored = base.where("lines % 2 = 0").select(
            "insight_key", "lines", "created_ms", F.when(F.col("lines") % 3 == 0, F.lit(5)).alias("dismissed_ms")
        )
        det = base.where("files + lines % 5 > 3").select("insight_key", (F.col("lines") + 7).alias("lines"), "created_ms")
        return Y.sync_insights(stored, det).drop("created_ms")

    @q.add(
        "S08_insert_new",
        """WITH b AS (SELECT 'k' || (tokens % 3000) AS key, event_id FROM log_events WHERE k % 2 = 0), e AS (SELECT DISTINCT 'k' || (tokens % 3000) AS key FROM log_events WHERE k % 2 = 1)
        SELECT key, min(event_id) AS event_id FROM b WHERE key NOT IN (SELECT key FROM e) GROUP BY key""",
    )
    def _(d):
        rows = d.log_events.select(F.concat(F.lit("k"), F.col("tokens") % 3000).alias("key"), "event_id", "k")
        batch = rows.where("k % 2 = 0").drop("k")
        return I.insert_new(batch, rows.where("k % 2 = 1").select("key").distinct(), ["key"], ["event_id"])

    @q.add(
        "S08_insert_report",
        """WITH b AS (SELECT 'k' || (tokens % 3000) AS key, event_id FROM log_events WHERE k % 2 = 0), e AS (SELECT DISTINCT 'k' || (tokens % 3000) AS key FROM log_events WHERE k % 2 = 1),
        i AS (SELECT count(DISTINCT key) AS n FROM b WHERE key NOT IN (SELECT key FROM e)) SELECT n AS inserted, (SELECT count(*) FROM b) - n AS duplicates FROM i""",
    )
    def _(d):
        rows = d.log_events.select(F.concat(F.lit("k"), F.col("tokens") % 3000).alias("key"), "event_id", "k")
        batch = rows.where("k % 2 = 0").drop("k")
        return I.insert_report(batch, I.insert_new(batch, rows.where("k % 2 = 1").select("key").distinct(), ["key"], ["event_id"]))

    upsert_sql = """SELECT coalesce(s.o_orderkey, n.o_orderkey) AS k, CASE WHEN n.o_orderkey IS NULL THEN s.o_custkey WHEN n.o_custkey % 3 = 0 AND s.o_orderkey IS NOT NULL THEN s.o_custkey
            WHEN n.o_custkey % 3 = 0 THEN NULL ELSE n.o_custkey END AS model, CASE WHEN s.o_orderkey IS NOT NULL THEN 'old' ELSE 'new' END AS summary,
          CASE WHEN s.o_orderkey IS NOT NULL AND s.o_custkey % 2 = 0 THEN 'old' WHEN n.o_orderkey IS NOT NULL THEN 'new' END AS cwd
        FROM (SELECT * FROM orders WHERE o_orderkey % 3 > 0) s FULL JOIN (SELECT * FROM orders WHERE o_orderkey % 4 > 0) n ON s.o_orderkey = n.o_orderkey"""

    @q.add("S09_upsert_sessions", upsert_sql)
    def _(d):
        k, c = F.col("o_orderkey").alias("k"), F.col("o_custkey")
        stored = d.orders.where("o_orderkey % 3 > 0").select(
            k, c.alias("model"), F.lit("old").alias("summary"), F.when(c % 2 == 0, "old").alias("cwd")
        )
        new = d.orders.where("o_orderkey % 4 > 0").select(
            k, F.when(c % 3 > 0, c).alias("model"), F.lit("new").alias("summary"), F.lit("new").alias("cwd")
        )
        return I.upsert(stored, new, ["k"], keep_stored=["summary"], fill_only=["cwd"])

    @q.add(
        "S10_upsert_repos",
        """SELECT 'n' || c_custkey AS root_path, CASE WHEN c_custkey % 3 = 0 THEN false ELSE c_custkey % 2 = 0 OR c_custkey % 7 = 1 END AS missing,
          CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 > 0 THEN 'new' ELSE 'old' END AS default_branch FROM customer""",
    )
    def _(d):
        c = F.col("c_custkey")
        stored = d.customer.select(
            c.alias("repo_id"), F.concat(F.lit("n"), c.cast("string")).alias("root_path"), (c % 2 == 0).alias("missing"),
            F.lit("old").alias("default_branch"), F.lit(1).cast("bigint").alias("last_seen_ms"),
        )
        stored = I.mark_missing(stored, stored.where("repo_id % 7 = 1").select("repo_id"))
        seen = d.customer.where(c % 3 == 0).select(
            F.concat(F.lit("n"), c.cast("string")).alias("root_path"), F.when(c % 5 > 0, "new").alias("default_branch")
        )
        return I.upsert_repos(stored, seen, NOW_MS).select("root_path", "missing", "default_branch")

    @q.add(
        "S11_upsert_outcomes",
        """SELECT session_id || ':' || repo_id || ':' || rel_path AS subject_key, CASE WHEN length(session_id) % 2 = 0 THEN 'lost' ELSE class END AS class FROM outcomes""",
    )
    def _(d):
        o = d.outcomes.select(
            F.lit("session-file").alias("scope"), F.lit(None).cast("string").alias("patch_id"), "session_id", "repo_id",
            "rel_path", "class", F.lit(1).alias("computed_ms"),
        )
        again = o.where("length(session_id) % 2 = 0").withColumn("class", F.lit("lost")).withColumn("computed_ms", F.lit(2))
        return I.upsert_outcomes(o, again).select("subject_key", "class")

    @q.add(
        "S12_retention",
        """SELECT 'sessions' AS name, count(*) AS n FROM sessions WHERE coalesce(ended_ms, last_ms) >= 900000000000
          UNION ALL SELECT 'patches', count(*) FROM patches JOIN sessions USING (session_id) WHERE coalesce(ended_ms, last_ms) >= 900000000000
          UNION ALL SELECT 'outcomes', count(*) FROM outcomes JOIN sessions USING (session_id) WHERE coalesce(ended_ms, last_ms) >= 900000000000""",
    )
    def _(d):
        kept = I.prune(d.sessions, {"patches": d.patches, "outcomes": d.outcomes}, 900_000_000_000)
        return I.row_counts(kept)

    @q.add("S13_delete_by_file", "SELECT event_id FROM log_events WHERE NOT (k % 5 = 0)")
    def _(d):
        rows = d.log_events.withColumn("file", F.concat(F.lit("f"), "k"))
        return I.delete_by_file(rows, rows.where("k % 5 = 0").select("file")).select("event_id")

    @q.add(
        "A20_scan_report",
        """SELECT 'events' AS name, count(*) AS n FROM log_events UNION ALL SELECT 'sessions', count(DISTINCT session_id) FROM log_events
          UNION ALL SELECT 'failed', count(*) FROM log_events WHERE status = 'failure'""",
    )
    def _(d):
        # What a scan writes is counted as it is written.
        events, of_events = I.counted(d.log_events, events=F.count(F.lit(1)), failed=F.count_if(F.col("status") == "failure"))
        stored = materialize(events, "events")
        sessions, of_sessions = I.counted(stored.groupBy("session_id").agg(F.max("ts_ms").alias("last_ms")), sessions=F.count(F.lit(1)))
        materialize(sessions, "sessions")
        return I.scan_report(d.spark, [of_events, of_sessions])

    @q.add(
        "A22_duplicate_calls",
        """SELECT 'claude-code' AS provider, count(*) AS calls, CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (s > 1) AS across_sessions FROM (
          SELECT count(*) AS n, count(DISTINCT session_id) AS s FROM log_events WHERE call_id IS NOT NULL GROUP BY call_id, coalesce(file_path, '/none') HAVING count(*) > 1)""",
    )
    def _(d):
        return I.duplicate_calls(d.log_events.withColumn("path", F.coalesce("file_path", F.lit("/none"))))


def register_views(q: Registry) -> None:
    page = f"""SELECT s.session_id, {AGENT.replace('provider', 's.provider')} AS agent, coalesce(n, 0) AS subagents, input_tokens + output_tokens + cached_tokens AS tokens
          FROM sessions s LEFT JOIN (SELECT parent_session_id AS pid, count(*) AS n FROM sessions WHERE coalesce(ended_ms, last_ms) >= {FROM_MS} AND started_ms < {TO_MS} GROUP BY 1) c ON c.pid = s.session_id
          WHERE s.parent_session_id IS NULL AND coalesce(ended_ms, last_ms) >= {FROM_MS} AND started_ms < {TO_MS} AND changed_files > 0 ORDER BY started_ms DESC, session_id DESC LIMIT 100 OFFSET 50"""

    @q.add("Q01_sessions_list", page)
    def _(d):
        rows = V.sessions_list(d.sessions, NOW_MS, from_ms=FROM_MS, to_ms=TO_MS, with_files=True, limit=100, offset=50)
        return rows.select("session_id", agent_name(F.col("provider")).alias("agent"), "subagents", "tokens")

    @q.add(
        "A16_Q02_session_files",
        """SELECT p.session_id, p.rel_path, edits, added, removed, class FROM (SELECT session_id, rel_path, count(*) AS edits, CAST(sum(added_raw) AS BIGINT) AS added, CAST(sum(removed_raw) AS BIGINT) AS removed
          FROM patches GROUP BY 1, 2) p LEFT JOIN outcomes o ON o.session_id = p.session_id AND o.rel_path = p.rel_path""",
    )
    def _(d):
        return V.session_files(d.patches, d.outcomes).select("session_id", "rel_path", "edits", "added", "removed", "class")

    @q.add(
        "A15_Q04_window_summary",
        f"""WITH a AS (SELECT * FROM sessions WHERE coalesce(ended_ms, last_ms) >= {TO_MS - 365 * DAY})
        SELECT count(*) FILTER (parent_session_id IS NULL) AS sessions, count(DISTINCT provider) FILTER (parent_session_id IS NULL) AS agents, count(DISTINCT repo_id) AS repos,
          count(*) FILTER (parent_session_id IS NULL AND {RUNNING.format(now=TO_MS)}) AS running,
          (SELECT count(*) FROM outcomes WHERE class = 'landed' AND session_id IN (SELECT session_id FROM a)) AS files_landed,
          (SELECT count(*) FROM outcomes WHERE class IN ('uncommitted', 'partial') AND session_id IN (SELECT session_id FROM a)) AS files_waiting,
          (SELECT count(*) FROM outcomes WHERE class = 'lost' AND session_id IN (SELECT session_id FROM a)) AS files_lost,
          (SELECT count(*) FROM loops WHERE state = 'open') AS open_loops FROM a""",
    )
    def _(d):
        return V.window_summary(d.sessions, d.outcomes, d.loops, TO_MS, days=365)

    @q.add(
        "A09_J16_outcome_distribution",
        f"SELECT provider, o.repo_id, class, count(*) AS n FROM outcomes o JOIN sessions s USING (session_id) WHERE started_ms >= {FROM_MS} AND started_ms < {TO_MS} GROUP BY ALL",
    )
    def _(d):
        return V.outcome_distribution(d.outcomes, d.sessions.drop("repo_id"), from_ms=FROM_MS, to_ms=TO_MS, by=["provider", "repo_id"])

    category = """CASE WHEN rel_path LIKE 'tests/%' THEN 'Tests' WHEN rel_path LIKE '%.md' OR rel_path LIKE '%.txt' THEN 'Docs' WHEN rel_path LIKE '%.json' THEN 'Config'
          WHEN rel_path LIKE '%.tsx' THEN 'UI' WHEN rel_path LIKE '%.sql' THEN 'Database' ELSE 'Code' END"""

    @q.add(
        "A12_fit_cells",
        f"""WITH c AS (SELECT o.repo_id, {category} AS category, provider, count(*) AS total, {KNOWN_COUNTS} FROM outcomes o JOIN sessions s USING (session_id) WHERE class <> 'unknown' GROUP BY 1, 2, 3)
        SELECT * FROM c WHERE (repo_id, category) IN (SELECT (repo_id, category) FROM c GROUP BY repo_id, category HAVING count(*) > 1 AND min(total) >= 30)""",
    )
    def _(d):
        return V.fit_cells(d.outcomes, d.sessions)

    @q.add(
        "A13_agent_comparison",
        f"""WITH c AS (SELECT o.repo_id, provider, count(*) AS total, {KNOWN_COUNTS}, count(*) FILTER (class = 'unknown') AS unknown FROM outcomes o JOIN sessions s USING (session_id) GROUP BY 1, 2),
        w AS (SELECT *, landed + uncommitted + partial + lost AS n FROM c),
        x AS (SELECT *, (landed / n + 2.706025 / (2 * n)) / (1 + 2.706025 / n) AS m, 1.645 * sqrt((landed / n) * (1 - landed / n) / n + 2.706025 / (4.0 * n * n)) / (1 + 2.706025 / n) AS h FROM w)
        SELECT repo_id, provider, total, landed, uncommitted, partial, lost, unknown, round(greatest(0, m - h), 6) AS landed_lo, round(least(1, m + h), 6) AS landed_hi FROM x
        WHERE repo_id IN (SELECT repo_id FROM c GROUP BY 1 HAVING count(*) > 1 AND min(total) >= 30)""",
    )
    def _(d):
        return V.agent_comparison(d.outcomes, d.sessions)

    @q.add(
        "A14_Q05_outcome_mix",
        "SELECT 'class' AS section, class AS name, count(*) AS n FROM outcomes GROUP BY 2 UNION ALL SELECT 'survival', survival, count(*) FROM outcomes WHERE class = 'landed' GROUP BY 2",
    )
    def _(d):
        return V.outcome_mix(d.outcomes, d.sessions)

    lag = """SELECT {by} count(*) AS n, round(list_sort(list(commit_lag_seconds))[CAST(floor(count(*) * 0.5) AS BIGINT) + 1] / 3600, 6) AS median_hours,
          round(list_sort(list(commit_lag_seconds))[CAST(floor(count(*) * 0.9) AS BIGINT) + 1] / 3600, 6) AS p90_hours FROM outcomes WHERE class = 'landed' AND commit_lag_seconds IS NOT NULL {group}"""

    @q.add("A14_commit_lag", lag.format(by="", group=""))
    def _(d):
        return V.commit_lag(d.outcomes)

    @q.add("A14_commit_lag_by_repo", lag.format(by="repo_id,", group="GROUP BY repo_id"))
    def _(d):
        return V.commit_lag(d.outcomes, ["repo_id"])

    @q.add(
        "Q05_repo_outcomes",
        f"SELECT o.repo_id, count(*) AS total, count(DISTINCT provider) AS agents, {KNOWN_COUNTS}, count(*) FILTER (class = 'superseded') AS superseded, count(*) FILTER (class = 'unknown') AS unknown FROM outcomes o JOIN sessions s USING (session_id) GROUP BY 1",
    )
    def _(d):
        repos = d.outcomes.select("repo_id").distinct()
        return V.repo_outcomes(d.outcomes, d.sessions, repos)

    @q.add(
        "A21_mix_parity",
        """WITH c AS (SELECT provider, class, count(*) AS n FROM outcomes JOIN sessions USING (session_id) WHERE class <> 'unknown' GROUP BY 1, 2),
        p AS (SELECT *, round(100 * n / sum(n) OVER (PARTITION BY provider), 1) AS pct FROM c),
        b AS (SELECT provider, class, 10.0 + 10 * length(class) AS base_pct FROM (SELECT DISTINCT provider FROM sessions), (SELECT unnest(['landed', 'lost', 'partial', 'superseded']) AS class))
        SELECT b.provider, b.class, coalesce(pct, 0.0) AS pct, CAST(base_pct AS DOUBLE) AS base_pct, round(coalesce(pct, 0.0) - CAST(base_pct AS DOUBLE), 1) AS delta, abs(round(coalesce(pct, 0.0) - CAST(base_pct AS DOUBLE), 1)) <= 2 AS ok
        FROM b LEFT JOIN p ON p.provider = b.provider AND p.class = b.class""",
    )
    def _(d):
        base = d.sessions.select("provider").distinct().select(
            "provider", F.explode(F.array(*[F.lit(c) for c in ("landed", "lost", "partial", "superseded")])).alias("class")
        ).withColumn("pct", F.lit(10.0) + 10 * F.length("class"))
        return V.mix_parity(d.outcomes, d.sessions, base)

    mix = f"SELECT thread_id, {KNOWN_COUNTS} FROM outcomes JOIN members USING (session_id) WHERE class <> 'unknown' GROUP BY 1"

    @q.add(
        "A17_thread_mix",
        f"SELECT t.thread_id, coalesce(landed, 0) AS landed, coalesce(uncommitted, 0) AS uncommitted, coalesce(partial, 0) AS partial, coalesce(lost, 0) AS lost FROM threads t LEFT JOIN ({mix}) m USING (thread_id)",
    )
    def _(d):
        return V.thread_mix(d.threads, d.members, d.outcomes).select("thread_id", *V.KNOWN)

    @q.add(
        "Q07_threads_list",
        f"""SELECT t.thread_id, title, last_ms, coalesce(landed, 0) AS landed, coalesce(lost, 0) AS lost FROM (SELECT * FROM threads WHERE status = 'dangling' ORDER BY last_ms DESC, thread_id LIMIT 300) t LEFT JOIN ({mix}) m USING (thread_id)""",
    )
    def _(d):
        return V.threads_list(d.threads, d.members, d.outcomes, 300, "dangling").select("thread_id", "title", "last_ms", "landed", "lost")

    @q.add("Q06_open_loops", "SELECT loop_key, lines FROM loops WHERE state = 'open'")
    def _(d):
        return V.loops_list(d.loops, "open").select("loop_key", "lines")

    @q.add("Q12_loops_for_repo", "SELECT loop_key, since_ms FROM loops WHERE state = 'open' AND repo_id = 'r7'")
    def _(d):
        return V.loops_for_repo(d.loops, "r7").select("loop_key", "since_ms")

    collisions = f"SELECT 'c:' || loop_key AS collision_key, repo_id, rel FROM (SELECT loop_key, repo_id, since_ms AS end_ms, lines AS rel FROM loops) WHERE repo_id = 'r3' AND end_ms >= {NOW_MS - 30 * DAY}"

    def stored_collisions(d):
        return d.loops.select(
            F.concat(F.lit("c:"), "loop_key").alias("collision_key"), "repo_id", F.col("since_ms").alias("end_ms"),
            F.col("lines").alias("rel"),
        )

    @q.add("Q08_collisions_list", collisions)
    def _(d):
        return V.collisions_list(stored_collisions(d), "r3", NOW_MS - 30 * DAY).drop("end_ms")

    def insights(d):
        return D.broken_sessions(d.sessions).withColumn(
            "dismissed_ms", F.when(F.length("session_id") % 2 == 0, F.lit(1).cast("bigint"))
        )

    @q.add(
        "Q08_insights_list",
        "SELECT status || '-session:' || session_id AS insight_key FROM sessions WHERE status IN ('failed', 'interrupted') AND parent_session_id IS NULL AND length(session_id) % 2 = 1",
    )
    def _(d):
        return V.insights_list(insights(d)).select("insight_key")

    folded = """fold AS (SELECT a.*, CASE WHEN p.session_id IS NOT NULL THEN p.session_id ELSE a.session_id END AS root FROM act a LEFT JOIN act p ON p.session_id = a.parent_session_id),
        work AS (SELECT root, rel_path, count(*) AS edits, max(ts_ms) AS last_edit_ms FROM patches p JOIN fold USING (session_id) GROUP BY 1, 2),
        st AS (SELECT root, rel_path, arg_min(class, (started_ms, session_id)) AS class FROM outcomes o JOIN fold USING (session_id) GROUP BY 1, 2),
        files AS (SELECT w.*, class, row_number() OVER (PARTITION BY w.root ORDER BY last_edit_ms DESC, w.rel_path) AS file_no, count(*) OVER (PARTITION BY w.root) AS n FROM work w LEFT JOIN st ON st.root = w.root AND st.rel_path = w.rel_path)"""

    @q.add(
        "Q09_recent_work",
        f"""WITH act AS (SELECT * FROM sessions WHERE repo_id = 'r8' AND coalesce(ended_ms, last_ms) >= {TO_MS - 200 * DAY}), {folded},
        page AS (SELECT * FROM fold WHERE root = session_id ORDER BY last_ms DESC, session_id DESC LIMIT 20)
        SELECT session_id, {AGENT} AS agent, last_ms, coalesce((SELECT max(n) FROM files f WHERE f.root = session_id), 0) AS files, f.file_no, f.rel_path, f.edits, f.class
        FROM page LEFT JOIN files f ON f.root = session_id AND f.file_no <= 3""",
    )
    def _(d):
        rows = V.recent_work(d.sessions, d.patches, d.outcomes, "r8", TO_MS, days=200, limit=20, files=3)
        return rows.select("session_id", "agent", "last_ms", "files", "file_no", "rel_path", "edits", "class")

    @q.add(
        "Q09_recent_work_in_path",
        f"""WITH act AS (SELECT * FROM sessions WHERE repo_id = 'r8' AND coalesce(ended_ms, last_ms) >= {TO_MS - 900 * DAY}), {folded}
        SELECT session_id, count(*) AS files FROM fold JOIN files f ON f.root = session_id WHERE fold.root = session_id AND rel_path LIKE 'src/%' GROUP BY 1, last_ms ORDER BY last_ms DESC, session_id DESC LIMIT 20""",
    )
    def _(d):
        rows = V.recent_work(d.sessions, d.patches, d.outcomes, "r8", TO_MS, path="src", days=900, limit=20, files=25)
        return rows.select("session_id", "files").distinct()

    fields = """fields AS (SELECT thread_id, 'title' AS field, title AS text FROM threads UNION ALL SELECT thread_id, 'title', title FROM sessions JOIN members USING (session_id)
          UNION ALL SELECT thread_id, 'branch', branch FROM threads UNION ALL SELECT thread_id, 'branch', coalesce(git_branch_end, git_branch_start) FROM sessions JOIN members USING (session_id)
          UNION ALL SELECT thread_id, 'commit', first_subject FROM outcomes JOIN members USING (session_id) UNION ALL SELECT thread_id, 'file', rel_path FROM outcomes JOIN members USING (session_id)
          UNION ALL SELECT thread_id, 'failure', 'make ' || status FROM sessions JOIN members USING (session_id))"""
    ranks = "CASE field WHEN 'title' THEN 0 WHEN 'branch' THEN 1 WHEN 'commit' THEN 2 WHEN 'file' THEN 3 ELSE 4 END"
    terms = ["urgent", "cust-12", "update", "nothing-here"]

    def thread_fields(d):
        fails = d.sessions.select("session_id", F.concat(F.lit("make "), "status").alias("signature"))
        return R.thread_fields(d.threads, d.members, d.sessions, d.outcomes, fails)

    first_hits = ", ".join(f"min({ranks}) FILTER (contains(lower(text), '{t}')) AS t{i}" for i, t in enumerate(terms))
    weight = "CASE t{0} WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 0 END"
    matched = " + ".join(f"(t{i} IS NOT NULL)::BIGINT" for i in range(4))
    scores = " + ".join(weight.format(i) for i in range(4))
    search = f"WITH {fields}, h AS (SELECT thread_id, {first_hits} FROM fields GROUP BY 1), z AS (SELECT thread_id, {matched} AS matched, CAST({scores} AS BIGINT) AS score FROM h)"

    @q.add("J21_search_threads", f"{search} SELECT * FROM z WHERE matched >= 2")
    def _(d):
        return R.search_threads(thread_fields(d), terms).select("thread_id", "matched", "score")

    @q.add(
        "Q10_prior_attempts",
        f"""{search}, best AS (SELECT z.*, last_ms FROM z JOIN threads USING (thread_id) WHERE matched >= 2 ORDER BY matched DESC, score DESC, last_ms DESC, thread_id LIMIT 10)
        SELECT thread_id, matched, score, CASE WHEN coalesce(landed + uncommitted + partial + lost, 0) = 0 THEN 'No file edits recorded' WHEN landed > 0 AND lost + uncommitted + partial = 0 THEN 'Landed'
          WHEN landed > 0 THEN 'Partly landed' WHEN uncommitted + partial > 0 THEN 'Left uncommitted' ELSE 'Did not land: the edits are in neither git history nor the working tree' END AS result
        FROM best LEFT JOIN ({mix}) m USING (thread_id)""",
    )
    def _(d):
        rows = V.prior_attempts(thread_fields(d), d.threads, d.members, d.outcomes, terms, 10)
        return rows.select("thread_id", "matched", "score", "result")

    steps = """s AS (SELECT s.*, thread_id FROM sessions s JOIN members USING (session_id)), fold AS (SELECT a.*, CASE WHEN p.session_id IS NOT NULL THEN p.session_id ELSE a.session_id END AS root
          FROM s a LEFT JOIN s p ON p.session_id = a.parent_session_id AND p.thread_id = a.thread_id),
        work AS (SELECT DISTINCT root, rel_path FROM patches JOIN fold USING (session_id)),
        st AS (SELECT root, rel_path, arg_max(class, (started_ms, session_id)) AS class FROM outcomes o JOIN fold USING (session_id) GROUP BY 1, 2),
        f AS (SELECT w.*, class FROM work w LEFT JOIN st USING (root, rel_path))"""

    @q.add(
        "Q11_resume_steps",
        f"WITH {steps} SELECT thread_id, session_id, count(f.root) AS files, {KNOWN_COUNTS} FROM fold LEFT JOIN f ON f.root = session_id WHERE fold.root = session_id GROUP BY 1, 2",
    )
    def _(d):
        return V.resume_steps(d.members, d.sessions, d.patches, d.outcomes).select("thread_id", "session_id", "files", *V.KNOWN)

    @q.add(
        "W08_Q11_resume_files",
        f"WITH {steps} SELECT thread_id, rel_path, arg_max({{'c': class}}, (started_ms, session_id)).c AS class FROM f JOIN fold ON fold.session_id = f.root AND fold.root = fold.session_id GROUP BY 1, 2",
    )
    def _(d):
        return V.resume_files(d.members, d.sessions, d.patches, d.outcomes).select("thread_id", "rel_path", "class")

    @q.add(
        "Q11_resume_failures",
        """WITH g AS (SELECT session_id, coalesce(display, tool_name, event_type) AS signature, count(*) AS n, max(ts_ms) AS last_ms FROM log_events WHERE event_type IN ('command.failed', 'tool.failed') GROUP BY 1, 2),
        r AS (SELECT split_part(session_id, '-', 1) AS thread_id, *, row_number() OVER (PARTITION BY split_part(session_id, '-', 1) ORDER BY last_ms DESC, signature, session_id) AS rn FROM g)
        SELECT thread_id, signature, n, last_ms, rn FROM r WHERE rn <= 5""",
    )
    def _(d):
        members = d.log_events.select("session_id", F.col("user_key").alias("thread_id")).distinct()
        return V.resume_failures(members, S.failure_groups(d.log_events, 1), 5).select("thread_id", "signature", "n", "last_ms", "rn")

    @q.add(
        "Q11_latest_thread",
        """SELECT thread_id FROM threads WHERE repo_id = 'r4' AND thread_id IN (SELECT thread_id FROM members JOIN outcomes USING (session_id) WHERE repo_id = 'r4') ORDER BY last_ms DESC, thread_id LIMIT 1""",
    )
    def _(d):
        return V.latest_thread(d.threads, d.members, d.outcomes, "r4").select("thread_id")

    @q.add(
        "Q13_J20_active_conflicts",
        f"""WITH act AS (SELECT * FROM (SELECT * REPLACE ({TO_MS} - (event_count * 30000) AS last_ms, CAST(NULL AS BIGINT) AS ended_ms) FROM sessions) WHERE repo_id = 'r5' AND last_ms >= {TO_MS} - 600000 AND {RUNNING.format(now=TO_MS)}), {folded}
        SELECT session_id, {AGENT} AS agent, (SELECT count(*) FROM files f WHERE f.root = session_id) AS editing, (SELECT count(*) FROM files f WHERE f.root = session_id AND (rel_path LIKE 'src/a/%' OR rel_path = 'ui/f5.tsx')) AS overlaps
        FROM fold WHERE root = session_id""",
    )
    def _(d):
        now = d.sessions.withColumn("last_ms", F.lit(TO_MS) - F.col("event_count") * 30_000).withColumn("ended_ms", F.lit(None).cast("bigint"))
        return V.active_conflicts(now, d.patches, d.outcomes, "r5", ["src/a", "ui/f5.tsx"], TO_MS).select("session_id", "agent", "editing", "overlaps")

    @q.add("Q14_data_as_of", "SELECT greatest(max(last_ms), 5) AS as_of_ms FROM sessions")
    def _(d):
        return V.data_as_of(d.sessions, 5)

    active = f"act AS (SELECT * FROM sessions WHERE started_ms < {DAY_TO} AND coalesce(ended_ms, last_ms) >= {DAY_FROM} AND last_ms >= {DAY_FROM})"

    @q.add(
        "A19_Q03_brief_activity",
        f"""WITH {active} SELECT count(*) FILTER (parent_session_id IS NULL) AS sessions, count(DISTINCT provider) AS providers, count(DISTINCT repo_id) AS repos,
          count(*) FILTER (usage_coverage = 'complete') AS sessions_with_usage, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
          CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens, CASE WHEN count(*) FILTER (usage_coverage = 'complete') = 0 THEN 'none' WHEN count(*) FILTER (usage_coverage = 'complete') = count(*) THEN 'complete' ELSE 'partial' END AS coverage FROM act""",
    )
    def _(d):
        return V.brief_activity(d.sessions, DAY_FROM, DAY_TO)

    @q.add("A19_brief_mix", f"WITH {active} SELECT class, count(*) AS n FROM outcomes WHERE class <> 'unknown' AND session_id IN (SELECT session_id FROM act) GROUP BY 1")
    def _(d):
        return V.brief_mix(d.sessions, d.outcomes, DAY_FROM, DAY_TO)

    @q.add(
        "A19_brief_left_off",
        f"SELECT thread_id, last_ms FROM threads WHERE status IN ('dangling', 'active', 'unknown') AND last_ms >= {DAY_FROM} - 172800000 AND last_ms < {DAY_TO} ORDER BY last_ms DESC, thread_id LIMIT 8",
    )
    def _(d):
        return V.brief_left_off(d.threads, DAY_FROM, DAY_TO, 8).select("thread_id", "last_ms")

    @q.add(
        "A19_brief_loops",
        f"SELECT count(*) AS open, count(*) FILTER (since_ms >= {NOW_MS - 10 * DAY} AND since_ms < {NOW_MS}) AS new_today, min(since_ms) AS oldest_ms FROM loops WHERE state = 'open'",
    )
    def _(d):
        return V.brief_loops(d.loops, NOW_MS - 10 * DAY, NOW_MS)

    @q.add(
        "A19_brief_top_loops",
        f"SELECT loop_key, round(lines * greatest(1.0, ({NOW_MS} - since_ms) / 86400000.0), 6) AS severity FROM loops WHERE state = 'open' ORDER BY lines * greatest(1.0, ({NOW_MS} - since_ms) / 86400000.0) DESC, since_ms, loop_key LIMIT 6",
    )
    def _(d):
        return V.brief_top_loops(d.loops, NOW_MS, 6).select("loop_key", "severity")

    @q.add(
        "A19_brief_landed",
        f"SELECT repo_id, count(*) AS files, CAST(sum(line_count) AS BIGINT) AS lines, count(DISTINCT first_sha) AS commits FROM outcomes WHERE class = 'landed' AND first_commit_ms >= {DAY_FROM} AND first_commit_ms < {DAY_TO} GROUP BY 1",
    )
    def _(d):
        return V.brief_landed(d.outcomes, DAY_FROM, DAY_TO)

    @q.add(
        "A19_brief_attention",
        f"""WITH {active}, {SQL_COLLISIONS}, met AS (SELECT * FROM result WHERE kind = 'overwrite' OR NOT EXISTS (SELECT 1 FROM result o WHERE o.kind = 'overwrite'
            AND o.repo_id = result.repo_id AND o.rel_path = result.rel_path AND o.session_a = result.session_a AND o.session_b = result.session_b)),
          m AS (SELECT 0 AS section, -started_ms AS pos, 'failure' AS kind, coalesce(title, 'A session') || ' in ' || coalesce(repo_id, 'no repo') || CASE status WHEN 'failed' THEN ' ended with an error' ELSE ' was interrupted' END AS message, session_id
          FROM act WHERE status IN ('failed', 'interrupted') AND parent_session_id IS NULL
          UNION ALL SELECT 0, -started_ms, 'awaiting-user', coalesce(title, 'A session') || ' in ' || coalesce(repo_id, 'no repo') || ' is waiting for your answer', session_id FROM act WHERE status = 'awaiting-user'
          UNION ALL SELECT 1, -end_ms, 'collision', CASE WHEN kind = 'overwrite' THEN 'One agent overwrote another''s unlanded edit in ' ELSE 'Two agents edited ' END || rel_path || ' (' || repo_id || ')', session_b
            FROM met WHERE end_ms >= {DAY_FROM} AND end_ms < {DAY_TO}
          UNION ALL SELECT 2, -last_ms, 'insight', 'Session ended with an error', session_id FROM act WHERE status = 'failed' AND parent_session_id IS NULL)
        SELECT kind, message, session_id FROM m ORDER BY section, pos, session_id, message LIMIT 5000""",
    )
    def _(d):
        met = detect_collisions(*collision_frames(d))
        return V.brief_attention(d.sessions, met, D.broken_sessions(d.sessions), DAY_FROM, DAY_TO, 5000).select("kind", "message", "session_id")

    @q.add(
        "A18_Q15_report_sessions",
        f"""SELECT count(*) FILTER (parent_session_id IS NULL) AS sessions, count(*) FILTER (parent_session_id IS NOT NULL) AS subagent_sessions, count(DISTINCT provider) FILTER (parent_session_id IS NULL) AS agents,
          CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens FROM sessions WHERE started_ms >= {FROM_MS} AND started_ms < {TO_MS}""",
    )
    def _(d):
        return V.report_sessions(d.sessions, FROM_MS, TO_MS)

    in_period = f"class <> 'unknown' AND session_id IN (SELECT session_id FROM sessions WHERE started_ms >= {FROM_MS} AND started_ms < {TO_MS})"

    @q.add(
        "A18_report_outcomes",
        f"""SELECT {KNOWN_COUNTS}, round(avg((class = 'landed')::INT), 6) AS landed_share, round(avg((survival = 'churned')::INT) FILTER (class = 'landed'), 6) AS churned_share,
          round((SELECT list_sort(list(commit_lag_seconds))[CAST(floor(count(*) * 0.5) AS BIGINT) + 1] / 3600 FROM outcomes WHERE class = 'landed' AND {in_period}), 6) AS median_hours FROM outcomes WHERE {in_period}""",
    )
    def _(d):
        return V.report_outcomes(d.sessions, d.outcomes, FROM_MS, TO_MS)

    @q.add("A18_report_areas", f"SELECT {category} AS name, count(*) AS files FROM outcomes WHERE {in_period} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
    def _(d):
        return V.report_areas(d.sessions, d.outcomes, FROM_MS, TO_MS, 5)

    @q.add(
        "A18_report_loops",
        f"""SELECT (SELECT count(*) FROM loops WHERE since_ms >= {NOW_MS - 40 * DAY} AND since_ms < {NOW_MS}) AS loops_created, (SELECT count(*) FROM loops WHERE state = 'resolved' AND since_ms >= {NOW_MS - 40 * DAY} AND since_ms < {NOW_MS}) AS loops_closed,
          (SELECT count(*) FROM loops WHERE since_ms >= {NOW_MS - 40 * DAY} AND since_ms < {NOW_MS}) AS collisions""",
    )
    def _(d):
        threads = d.threads.withColumn("providers", F.array(F.lit("x")))
        rows = V.report_loops(d.loops, stored_collisions(d), threads, NOW_MS - 40 * DAY, NOW_MS)
        return rows.select("loops_created", "loops_closed", "collisions")

    @q.add(
        "A18_biggest_thread",
        f"""SELECT sessions AS biggest_sessions, CAST(2 AS BIGINT) AS biggest_agents, CAST(greatest(1, floor((last_ms - started_ms) / 86400000 + 0.5)) AS BIGINT) AS biggest_days
          FROM threads WHERE started_ms >= {FROM_MS} AND started_ms < {TO_MS} ORDER BY sessions DESC, started_ms, thread_id DESC LIMIT 1""",
    )
    def _(d):
        threads = d.threads.withColumn("providers", F.array(F.lit("x"), F.lit("y")))
        rows = V.report_loops(d.loops, stored_collisions(d), threads, FROM_MS, TO_MS)
        return rows.select("biggest_sessions", "biggest_agents", "biggest_days")

    @q.add(
        "A23_health_checks",
        f"""WITH RECURSIVE {SELF_CHECK} SELECT 'last-scan' AS name, 'WARN' AS status, CAST(9 AS BIGINT) AS n UNION ALL SELECT 'parser-coverage', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'WARN' END, count(*) FROM log_events WHERE status = 'failure'
          UNION ALL SELECT 'outcome-self-check', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'WARN' END, count(*) FROM checks WHERE confidence = 'low'""",
        recursive=True,
    )
    def _(d):
        _, lines, _ = patch_frames(d)
        checks = M.self_check(lines, d.hits)
        return V.health_checks(d.sessions, d.log_events.where("status = 'failure'"), checks, NOW_MS - 9 * DAY, NOW_MS)

    @q.add(
        "S16_export_rows",
        """SELECT loop_key, '{"loop_key":' || to_json(loop_key) || ',"lines":' || lines || ',"state":"' || state || '"}' AS value FROM loops""",
    )
    def _(d):
        path = f"{checkpoint_dir(d.spark)}/export-{uuid.uuid4().hex}"
        V.export_json(d.loops.select("loop_key", "lines", "state"), path)
        return d.spark.read.text(path).select(F.get_json_object("value", "$.loop_key").alias("loop_key"), "value")

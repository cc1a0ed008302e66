"""Readers and per-line normalization over log lines made from driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from worklake.bindings import KEY, Domain
from worklake.functions.text import squeeze
from worklake.operators import ingest as I
from worklake.operators import usage as U
from worklake.operators.incremental import refresh_rows
from worklake.operators.ordered import checkpoint_dir
from worklake.plans import log_lines
from worklake.plans.registry import Registry
from worklake.plans.text_queries import sql_norm, sql_significant
from worklake.sources import dialect_a as A
from worklake.sources import dialect_b as B
from worklake.sources import files as S
from worklake.sources import hooks as H

# What the transcript binding says, straight from the table.
TURNS = """
    c AS (SELECT conv_id, turn, role, text, length(text) AS n, conv_id % 5 = 4 AS sub,
        1704067200000 + conv_id * 3600000 + turn * 60000 AS ms,
        'c' || (conv_id - CASE WHEN conv_id % 5 = 4 THEN 1 ELSE 0 END) || CASE WHEN conv_id % 5 = 4 THEN ':a' || conv_id ELSE '' END AS session_id
      FROM conversations),
    tools AS (SELECT conv_id, turn, CASE n % 5 WHEN 0 THEN 'Bash' WHEN 1 THEN 'Edit' WHEN 2 THEN 'AskUserQuestion'
        WHEN 3 THEN 'Task' ELSE 'mcp__db__query' END AS tool FROM c WHERE role = 'assistant'),
    results AS (SELECT c.*, n % 2 = 0 AS failed, n % 11 = 0 AS denied, n % 7 > 0 AS has_result, tool,
        starts_with(text, '[Request interrupted by user') AS stopped
      FROM c LEFT JOIN tools t ON t.conv_id = c.conv_id AND t.turn = c.turn - 1
      WHERE role = 'user' AND c.turn > 0 AND n % 3 > 0),
    family AS (SELECT *, CASE WHEN tool = 'Bash' THEN 'shell' WHEN tool = 'Edit' THEN 'file' WHEN tool = 'mcp__db__query' THEN 'mcp'
        WHEN tool IS NOT NULL THEN 'other' WHEN has_result THEN 'file' ELSE 'other' END AS category FROM results),
    plines AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM family WHERE NOT failed AND NOT denied AND has_result),
    extra(i) AS (SELECT unnest(range(11))),
    extras AS (SELECT conv_id, i FROM (SELECT DISTINCT conv_id FROM conversations) k JOIN extra e ON conv_id % (i + 2) = 0)"""
PATCHED = "SELECT conv_id, turn FROM plines GROUP BY 1, 2 HAVING count(*) FILTER (i % 3 <> 1) > 0"
EVENTS_A = f"""{TURNS},
    patched AS ({PATCHED}),
    ev AS (
      SELECT conv_id, turn, CASE t.tool WHEN 'Bash' THEN 'command.started' WHEN 'Task' THEN 'subagent.started' ELSE 'tool.started' END AS event_type FROM tools t
      UNION ALL SELECT conv_id, turn, 'session.awaiting-user' FROM tools WHERE tool = 'AskUserQuestion'
      UNION ALL SELECT conv_id, turn, 'turn.completed' FROM c WHERE role = 'assistant' AND n % 4 = 0
      UNION ALL SELECT conv_id, turn, 'error' FROM c WHERE role = 'system' AND conv_id % 2 = 0
      UNION ALL SELECT conv_id, turn, 'prompt.submitted' FROM c WHERE role = 'user' AND NOT (turn > 0 AND n % 3 > 0)
      UNION ALL SELECT conv_id, turn, CASE WHEN denied THEN 'approval.resolved'
          WHEN category = 'shell' THEN CASE WHEN failed THEN 'command.failed' ELSE 'command.completed' END
          WHEN tool = 'Task' THEN 'subagent.ended'
          WHEN failed THEN 'tool.failed' ELSE 'tool.completed' END FROM family
      UNION ALL SELECT conv_id, turn, 'edit.applied' FROM patched
      UNION ALL SELECT conv_id, NULL, 'unknown' FROM extras WHERE i = 10)"""


def a_logs(d: Domain) -> A.Logs:
    return A.read(log_lines.transcripts(d), KEY)


def b_logs(d: Domain) -> B.Logs:
    return B.read(log_lines.rollouts(d), KEY)


EVENTS_B = """
    e AS (SELECT user_id, event_id, event_type AS t, K[props] AS k, MS[ts] AS ms, INT[floor(value * 100)] AS v,
        lpad(CAST(user_id AS VARCHAR), 8, '0') || '-0000-4000-8000-000000000000' AS session_id FROM events)"""


def register(q: Registry) -> None:
    @q.add(
        "S01_transcript_order",
        """SELECT conv_id, conv_id % 5 = 4 AS is_sub, row_number() OVER (ORDER BY conv_id % 5 = 4, 2000000000000 - conv_id) AS place
          FROM (SELECT DISTINCT conv_id FROM conversations)""",
    )
    def _(d):
        from worklake.operators.ordered import positions

        lines = log_lines.transcripts(d).withColumn("conv_id", F.regexp_extract("file", r"(\d+)\.jsonl$", 1).cast("bigint"))
        timed = lines.withColumn("file_time", F.timestamp_millis(F.lit(2_000_000_000_000) - F.col("conv_id")))
        ordered = S.transcript_order(timed).select("conv_id", "is_sub", "precedence").distinct()
        # Sub flag, fixed-width time and path sort as one string, so files of one time keep an order.
        key = F.concat(F.col("precedence.sub").cast("int"), F.lpad(F.col("precedence.t").cast("string"), 16, "0"), F.lit("\0"), F.col("precedence.file"))
        placed = positions(ordered.withColumn("k", key).withColumn("g", F.lit(0)), ["g"], "k", "p")
        return placed.select("conv_id", "is_sub", (F.col("p") + 1).alias("place"))

    @q.add(
        "S02_rollout_sessions",
        f"WITH {EVENTS_B} SELECT session_id, count(*) * 2 + count(*) FILTER (t IN ('purchase', 'click')) + 1 AS lines FROM e GROUP BY 1",
    )
    def _(d):
        timed = log_lines.rollouts(d).drop("session_from_name")
        rows = S.rollout_order(timed)
        return rows.groupBy(F.col("session_from_name").alias("session_id")).agg(F.count("*").alias("lines"))

    @q.add(
        "S03_thread_names",
        """SELECT 'u' || user_id AS session_id, max_by('k' || K[props], event_id) AS title, 'generated' AS title_provenance
          FROM events GROUP BY user_id""",
    )
    def _(d):
        index = d.events.select(
            F.lit("session_index.jsonl").alias("file"), F.col("event_id").alias("ordinal"),
            F.to_json(
                F.struct(
                    F.concat(F.lit("u"), "user_id").alias("id"),
                    F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("thread_name"),
                )
            ).alias("value"),
        )
        return B.thread_names(index)

    @q.add(
        "S04_plan_reads",
        """SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'read' WHEN o_orderkey % 4 = 1 THEN 'reset' WHEN o_orderkey % 10 = 2 THEN 'reset'
            WHEN o_orderkey % 4 = 2 THEN 'skip' WHEN o_custkey % 2 = 0 THEN 'tail' ELSE 'reset' END AS action, count(*) AS n FROM orders GROUP BY 1""",
    )
    def _(d):
        k = F.col("o_orderkey")
        path = F.concat(F.lit("/f/"), k.cast("string"))
        listing = d.orders.select(path.alias("path"), k.alias("inode"), F.lit(1000).alias("size"))
        done = d.orders.where(k % 4 > 0).select(
            path.alias("path"), F.when(k % 4 == 1, k + 1).otherwise(k).alias("inode"),
            F.when(k % 4 == 2, 1000).when(F.col("o_custkey") % 2 == 0, 400).otherwise(2000).alias("byte_offset"),
            F.when(k % 10 == 2, "p@1").otherwise("p@2").alias("parser_version"),
        )
        return S.plan_reads(listing, done, "p@2").groupBy("action").agg(F.count("*").alias("n"))

    @q.add("S04_incremental_events", f"WITH {EVENTS_A} SELECT event_type, count(*) AS n FROM ev GROUP BY 1")
    def _(d):
        # Transcripts as files in two folders: the second run finds one grown, one new and one rewritten.
        run = f"{checkpoint_dir(d.spark)}/logs-{uuid.uuid4().hex}"
        lines = log_lines.transcripts(d).withColumn("part", F.pmod(F.xxhash64("file"), F.lit(6)))
        blank = F.when(F.col("part") == 1, F.lit("")).otherwise(F.col("value"))
        first = lines.where("part < 5 and (part <> 2 or ordinal < 3)").withColumn("value", blank)
        for written in (first, lines.where("part in (1, 2, 5)")):
            files = written.repartition("part").sortWithinPartitions("file", "ordinal").select("part", "value").write
            files = files.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part")
            files.format("text").save(f"{run}/in")
            refresh_rows(d.spark, f"{run}/in", f"{run}/store", "1", lambda rows: A.read(rows, KEY).events, 16, "*.txt")
        return d.spark.read.parquet(f"{run}/store/rows").groupBy("event_type").agg(F.count("*").alias("n"))

    @q.add(
        "N01_skip_heavy_lines",
        f"WITH {EVENTS_B} SELECT session_id, count(*) + count(*) FILTER (t IN ('purchase', 'click')) + 1 AS kept FROM e GROUP BY 1",
    )
    def _(d):
        rows = B.skip_heavy(log_lines.rollouts(d))
        return rows.groupBy(F.col("session_from_name").alias("session_id")).agg(F.count("*").alias("kept"))

    @q.add(
        "N02_line_triage",
        f"""WITH {TURNS}, dis AS (SELECT 'known' AS disposition FROM c
          UNION ALL SELECT CASE i WHEN 0 THEN 'title' WHEN 1 THEN 'cost' WHEN 2 THEN 'title' WHEN 3 THEN 'ignored' WHEN 4 THEN 'unknown-type'
            WHEN 5 THEN 'missing-field' WHEN 6 THEN 'not-an-object' WHEN 7 THEN 'invalid-json' WHEN 9 THEN 'invalid-timestamp' ELSE 'unknown' END
          FROM extras WHERE i <> 8) SELECT disposition, count(*) AS n FROM dis GROUP BY 1""",
    )
    def _(d):
        return A.triage(log_lines.transcripts(d)).groupBy("disposition").agg(F.count("*").alias("n"))

    @q.add(
        "N02_failures",
        f"""WITH {TURNS} SELECT CASE i WHEN 5 THEN 'missing-field' WHEN 6 THEN 'not-an-object' WHEN 7 THEN 'invalid-json' ELSE 'invalid-timestamp' END AS reason,
          conv_id FROM extras WHERE i IN (5, 6, 7, 9)""",
    )
    def _(d):
        return a_logs(d).failures.select("reason", F.regexp_extract("file", r"(\d+)\.jsonl$", 1).cast("bigint").alias("conv_id"))

    @q.add(
        "N03_unknown_types",
        f"WITH {TURNS} SELECT CASE i WHEN 4 THEN 'brand-new' ELSE 'novel' END AS type, count(*) AS n FROM extras WHERE i IN (4, 10) GROUP BY 1",
    )
    def _(d):
        return a_logs(d).unknown_types

    @q.add(
        "N04_subagent_sessions",
        f"WITH {TURNS} SELECT session_id, CASE WHEN sub THEN split_part(session_id, ':', 1) END AS parent_session_id, count(*) AS lines FROM c GROUP BY 1, 2",
    )
    def _(d):
        rows = A.identify(A.triage(log_lines.transcripts(d))).where("type <> 'novel'")
        return rows.groupBy("session_id", "parent_session_id").agg(F.count("*").alias("lines"))

    @q.add("N05_N07_transcript_events", f"WITH {EVENTS_A} SELECT event_type, conv_id, count(*) AS n FROM ev GROUP BY 1, 2")
    def _(d):
        conv = F.regexp_extract("file", r"(\d+)\.jsonl$", 1).cast("bigint")
        return a_logs(d).events.groupBy("event_type", conv.alias("conv_id")).agg(F.count("*").alias("n"))

    @q.add(
        "N06_tool_taxonomy",
        f"""WITH {TURNS} SELECT tool AS tool_name, CASE tool WHEN 'Bash' THEN 'shell' WHEN 'Edit' THEN 'file' WHEN 'mcp__db__query' THEN 'mcp' ELSE 'other' END AS category,
          count(*) AS n FROM tools GROUP BY 1, 2""",
    )
    def _(d):
        calls = a_logs(d).events.where("event_type in ('command.started', 'tool.started', 'subagent.started')")
        return calls.groupBy("tool_name", F.col("tool_category").alias("category")).agg(F.count("*").alias("n"))

    @q.add(
        "N08_pair_results_with_calls",
        f"""WITH {TURNS} SELECT conv_id, turn, coalesce(tool, 'unknown') AS tool_name, category,
          CASE WHEN tool = 'Bash' AND NOT denied THEN 'make' END AS executable,
          CASE WHEN tool = 'Bash' AND NOT denied THEN 'cd /x && make t' || (conv_id % 9) END AS display FROM family""",
    )
    def _(d):
        kinds = (
            "approval.resolved", "command.failed", "command.completed", "subagent.ended", "tool.failed", "tool.completed",
        )
        rows = a_logs(d).events.where(F.col("event_type").isin(*kinds))
        return rows.select(
            F.regexp_extract("file", r"(\d+)\.jsonl$", 1).cast("bigint").alias("conv_id"),
            (F.col("ordinal") - 1).alias("turn"), "tool_name", F.col("tool_category").alias("category"), "executable", "display",
        )

    sig = f"{sql_significant('x.n')}"

    @q.add(
        "N09_patches_from_hunks",
        f"""WITH {TURNS}, nl AS (SELECT conv_id, turn, i, {sql_norm('nfc_normalize(line)')} AS n FROM plines),
        gone AS (SELECT DISTINCT conv_id, turn, n FROM nl x WHERE i % 3 = 2 AND {sig}),
        fresh AS (SELECT DISTINCT conv_id, turn, n FROM nl x WHERE i % 3 = 0 AND {sig})
        SELECT p.conv_id, p.turn, '/w/r/f' || (p.conv_id % 7) || '.ts' AS path, 'modify' AS operation,
          (SELECT count(*) FROM plines l WHERE l.conv_id = p.conv_id AND l.turn = p.turn AND i % 3 = 0) AS added_raw,
          (SELECT count(*) FROM plines l WHERE l.conv_id = p.conv_id AND l.turn = p.turn AND i % 3 = 2) AS removed_raw,
          (SELECT count(*) FROM gone g WHERE g.conv_id = p.conv_id AND g.turn = p.turn) AS removed,
          (SELECT count(*) FROM fresh f WHERE f.conv_id = p.conv_id AND f.turn = p.turn
             AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.conv_id = f.conv_id AND g.turn = f.turn AND g.n = f.n)) AS added
        FROM ({PATCHED}) p""",
    )
    def _(d):
        return a_logs(d).patches.select(
            F.regexp_extract("file", r"(\d+)\.jsonl$", 1).cast("bigint").alias("conv_id"),
            (F.col("ordinal") - 1).alias("turn"), "path", "operation", "added_raw", "removed_raw",
            F.size("added_fps").alias("added"), F.size("removed_fps").alias("removed"),
        )

    @q.add(
        "N10_rollout_events",
        f"""WITH {EVENTS_B}, ev AS (
          SELECT session_id, CASE WHEN t = 'click' THEN CASE WHEN k % 3 = 0 THEN 'command.failed' ELSE 'command.completed' END
            WHEN t = 'view' AND k % 2 = 0 THEN CASE WHEN k % 10 = 0 THEN 'approval.resolved' ELSE 'edit.applied' END
            WHEN t = 'view' THEN CASE WHEN k % 5 = 0 THEN 'tool.failed' ELSE 'tool.completed' END
            WHEN t = 'error' AND k % 2 = 0 THEN 'agent.interrupted' WHEN t = 'error' THEN 'unknown'
            ELSE 'turn.completed' END AS event_type FROM e WHERE t <> 'signup'
          UNION ALL SELECT session_id, 'edit.applied' FROM e WHERE t = 'view' AND k % 2 = 0 AND k % 10 > 1
          UNION ALL SELECT DISTINCT session_id, 'session.started' FROM e)
        SELECT session_id, event_type, count(*) AS n FROM ev GROUP BY 1, 2""",
    )
    def _(d):
        return b_logs(d).events.groupBy("session_id", "event_type").agg(F.count("*").alias("n"))

    @q.add(
        "N11_N12_file_changes",
        f"""WITH {EVENTS_B}, ctx AS (SELECT session_id, event_id, k % 3 AS c FROM e WHERE t = 'signup'),
        ch AS (SELECT * FROM e WHERE t = 'view' AND k % 2 = 0 AND k % 10 > 1),
        placed AS (SELECT ch.session_id, ch.event_id, ch.k,
            (SELECT max_by(c, ctx.event_id) FROM ctx WHERE ctx.session_id = ch.session_id AND ctx.event_id < ch.event_id) AS c FROM ch)
        SELECT event_id, coalesce('/w/u' || c, '/w/start') || '/src/f' || (k % 4) || '.ts' AS path, 'modify' AS operation, CAST(1 AS BIGINT) AS added_raw, CAST(1 AS BIGINT) AS removed_raw FROM placed
        UNION ALL SELECT event_id, '/abs/g.ts', 'create', 1, 0 FROM placed""",
    )
    def _(d):
        rows = b_logs(d).patches
        return rows.select(
            F.floor((F.col("ordinal") - 1) / 3).alias("event_id"), "path", "operation",
            "added_raw", "removed_raw",
        )

    @q.add(
        "N13_fork_copies",
        """SELECT 'fork-' || user_id AS file, count(*) FILTER (NOT (o < 5 AND MS[ts] - first <= 200000000)) AS kept FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS o, min(MS[ts]) OVER (PARTITION BY user_id) AS first FROM events) GROUP BY user_id""",
    )
    def _(d):
        from pyspark.sql import Window

        # Forked rollouts: user rows with their rank as log ordinal, times shrunk so that the copied
        # burst lies within the fork window.
        w = Window.partitionBy("user_id")
        ms = F.unix_millis(F.col("ts").cast("timestamp"))
        r = d.events.select(
            F.concat(F.lit("fork-"), "user_id").alias("file"),
            F.row_number().over(w.orderBy("event_id")).alias("o"),
            (ms - F.min(ms).over(w)).alias("since"),
        )
        at = F.date_format(F.timestamp_millis(F.floor(F.col("since") / 200_000)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        edge = F.col("since") % 200_000 > 0
        stamp = F.date_format(
            F.timestamp_millis(F.floor(F.col("since") / 200_000) + edge.cast("int")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
        )
        body = r.select(
            "file", F.col("o").cast("bigint").alias("ordinal"),
            F.concat(F.lit('{"timestamp":"'), stamp, F.lit('","ordinal":'), "o", F.lit(',"type":"event_msg","payload":{"type":"item_completed","item":{"type":"WebSearch","id":"x"}}}')).alias("value"),
        )
        header = r.select("file").distinct().select(
            "file", F.lit(0).cast("bigint").alias("ordinal"),
            F.lit('{"timestamp":"1970-01-01T00:00:00Z","type":"session_meta","payload":{"id":"s","forked_from_id":"p","subagent_history_start_ordinal":5}}').alias("value"),
        )
        raw = body.unionByName(header).withColumn("session_from_name", F.lit(None).cast("string"))
        lines = B.triage(raw)
        own = B.own_lines(lines, B.headers(lines, raw))
        return own.groupBy("file").agg(F.count("*").alias("kept"))

    @q.add(
        "N14_session_headers",
        f"WITH {EVENTS_B} SELECT session_id, '/w/start' AS cwd, 'main' AS git_branch, min(ms) AS head_ms FROM e GROUP BY 1",
    )
    def _(d):
        raw = log_lines.rollouts(d)
        return B.headers(B.triage(raw), raw).select(
            "session_id", F.col("head_cwd").alias("cwd"), "git_branch", "head_ms"
        )

    @q.add(
        "N15_unwrap_argv",
        """SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'run ' || (o_custkey % 20) WHEN o_orderkey % 3 = 1 THEN 'git log ' || (o_custkey % 20)
            ELSE 'plain ' || (o_custkey % 20) END AS command, count(*) AS n FROM orders GROUP BY 1""",
    )
    def _(d):
        k, a = F.col("o_orderkey") % 3, (F.col("o_custkey") % 20).cast("string")
        doc = (
            F.when(k == 0, F.concat(F.lit('{"command":["/bin/bash","-lc","run '), a, F.lit('"]}')))
            .when(k == 1, F.concat(F.lit('{"command":["git","log","'), a, F.lit('"]}')))
            .otherwise(F.concat(F.lit('{"command":"plain '), a, F.lit('"}')))
        )
        rows = d.orders.select(B.command_text(F.parse_json(doc)).alias("command"))
        return rows.groupBy("command").agg(F.count("*").alias("n"))

    @q.add(
        "N16_N18_session_facts",
        f"""WITH {TURNS}, f AS (SELECT session_id, min(ms) AS first_ms, max(ms) AS last_ms, CASE WHEN max(turn) < 3 THEN 'main' ELSE 'feat/x' END AS branch_last FROM c GROUP BY 1),
        novel AS (SELECT DISTINCT 'c' || (conv_id - CASE WHEN conv_id % 5 = 4 THEN 1 ELSE 0 END) AS session_id FROM extras WHERE i = 10),
        t AS (SELECT 'c' || (conv_id - CASE WHEN conv_id % 5 = 4 THEN 1 ELSE 0 END) AS session_id, conv_id, i,
            CASE WHEN conv_id % 5 = 4 THEN '/logs/p/c' || (conv_id - 1) || '/subagents/agent-' || conv_id || '.jsonl' ELSE '/logs/p/c' || conv_id || '.jsonl' END AS file FROM extras),
        best AS (SELECT session_id, max_by(CASE i WHEN 0 THEN 'Title ' || conv_id ELSE 'Generated' END, (i = 0, file)) AS title, bool_or(i = 0) AS seen FROM t WHERE i IN (0, 2) GROUP BY 1),
        cost AS (SELECT session_id, max_by(conv_id / 8, file) AS cost_usd FROM t WHERE i = 1 GROUP BY 1),
        spans AS (SELECT coalesce(f.session_id, n.session_id) AS session_id, least(first_ms, CASE WHEN n.session_id IS NOT NULL THEN 1704067200000 END) AS first_ms,
            greatest(last_ms, CASE WHEN n.session_id IS NOT NULL THEN 1704067200000 END) AS last_ms,
            branch_last FROM f FULL JOIN novel n ON n.session_id = f.session_id)
        SELECT coalesce(s.session_id, b.session_id, k.session_id) AS session_id, first_ms, last_ms, branch_last, title,
          CASE WHEN seen THEN 'observed' WHEN title IS NOT NULL THEN 'generated' END AS title_provenance, round(cost_usd, 6) AS cost_usd
        FROM spans s FULL JOIN best b ON b.session_id = s.session_id FULL JOIN cost k ON k.session_id = coalesce(s.session_id, b.session_id)""",
    )
    def _(d):
        return a_logs(d).sessions.select(
            "session_id", "first_ms", "last_ms", "branch_last", "title", "title_provenance", "cost_usd"
        )

    @q.add(
        "N19_hook_signals",
        """SELECT event_type, provider_event_type, status, tool_name, count(*) AS n FROM (SELECT
          CASE k % 3 WHEN 0 THEN 'approval.requested' WHEN 1 THEN CASE WHEN k % 2 = 0 THEN 'approval.requested' END ELSE 'session.ended' END AS event_type,
          CASE k % 3 WHEN 0 THEN 'hook:PermissionRequest' WHEN 1 THEN 'hook:Notification' ELSE 'hook:SessionEnd:' || CASE WHEN k % 2 = 0 THEN 'exit' ELSE 'other' END END AS provider_event_type,
          CASE WHEN k % 3 = 0 OR (k % 3 = 1 AND k % 2 = 0) THEN 'started' END AS status,
          CASE WHEN k % 3 = 0 THEN 'T' || (k % 4) END AS tool_name FROM log_events) GROUP BY ALL""",
    )
    def _(d):
        k = F.col("k")
        payload = F.to_json(
            F.struct(
                F.col("session_id"),
                F.when(k % 3 == 0, "PermissionRequest").when(k % 3 == 1, "Notification").otherwise("SessionEnd").alias("hook_event_name"),
                F.concat(F.lit("T"), k % 4).alias("tool_name"),
                F.when(k % 2 == 0, "permission_prompt").otherwise("idle").alias("notification_type"),
                F.when(k % 2 == 0, "exit").alias("reason"),
            )
        )
        rows = d.log_events.select(payload.alias("value"), F.col("ts_ms").alias("received_ms"))
        return H.normalize_hooks(rows, "claude-code").groupBy(
            "event_type", "provider_event_type", "status", "tool_name"
        ).agg(F.count("*").alias("n"))

    @q.add(
        "W01_counter_deltas",
        f"""WITH {EVENTS_B}, r AS (SELECT session_id, event_id, ms, v % 4000 AS total, v % 3000 AS i, v % 700 AS c, v % 500 AS o, v % 90 AS r FROM e WHERE t IN ('purchase', 'click')),
        k AS (SELECT *, lag(total) OVER w AS pt FROM r WINDOW w AS (PARTITION BY session_id ORDER BY event_id)),
        kept AS (SELECT * FROM k WHERE pt IS NULL OR pt <> total),
        z AS (SELECT *, lag(total) OVER w AS lt, lag(i) OVER w AS li, lag(c) OVER w AS lc, lag(o) OVER w AS lo, lag(r) OVER w AS lr FROM kept WINDOW w AS (PARTITION BY session_id ORDER BY event_id)),
        dl AS (SELECT session_id, event_id, total, CASE WHEN total > lt THEN greatest(0, i - li) ELSE 100 END AS di, CASE WHEN total > lt THEN greatest(0, c - lc) ELSE 10 END AS dc,
            CASE WHEN total > lt THEN greatest(0, o - lo) ELSE 7 END AS dout, CASE WHEN total > lt THEN greatest(0, r - lr) ELSE 1 END AS dr FROM z)
        SELECT session_id, event_id, session_id || ':cum:' || total AS usage_key, greatest(0, di - dc) AS input_tokens, dc AS cached_tokens, dout AS output_tokens, dr AS reasoning_tokens FROM dl""",
    )
    def _(d):
        return b_logs(d).usage.select(
            "session_id", F.floor((F.col("ordinal") - 3) / 3).alias("event_id"), "usage_key", "input_tokens",
            "cached_tokens", "output_tokens", "reasoning_tokens",
        )

    @q.add(
        "A07_A08_usage",
        f"""WITH {TURNS} SELECT session_id, count(*) AS usage_records, CAST(sum(n + turn) AS BIGINT) AS input_tokens, CAST(sum(n // 2) AS BIGINT) AS output_tokens,
          CAST(sum(turn * 10) AS BIGINT) AS cached_tokens, 'complete' AS usage_coverage FROM c WHERE role = 'assistant' GROUP BY 1
        UNION ALL SELECT session_id, 0, NULL, NULL, NULL, 'none' FROM c GROUP BY 1 HAVING count(*) FILTER (role = 'assistant') = 0""",
    )
    def _(d):
        ident = A.identify(A.triage(log_lines.transcripts(d)))
        sessions = ident.where("type <> 'novel'").select("session_id").distinct()
        reports = A.usage_lines(ident)
        # The same message reported twice, first with smaller counts.
        early = reports.withColumn("output_tokens", F.floor(F.col("output_tokens") / 3))
        return U.usage_totals(sessions, U.merge_usage(reports.unionByName(early))).drop("reasoning_tokens")

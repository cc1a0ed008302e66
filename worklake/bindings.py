"""Driver tables as the domain frames, so that every operator runs on rows that grow with them.

Each binding is one SELECT that Spark SQL and DuckDB both run; only the few functions that differ
are spelled per engine. Bindings map inputs only: the operators under test are not in here.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
KEY = b"worklake test key"
NOW_MS = 1_000_000_000_000  # 2001-09-09, just after the last order
EVENTS_NOW_MS = 1_706_659_200_000  # 2024-01-31, the end of the events table

SPARK = {
    "MS": "unix_millis(CAST({} AS timestamp))",
    "K": "CAST(get_json_object({}, '$.k') AS bigint)",
    "SHA": "sha2({}, 256)",
    "INT": "CAST({} AS bigint)",
}
DUCK = {
    "MS": "(epoch_us({}) // 1000)",
    "K": "CAST(json_extract_string({}, '$.k') AS bigint)",
    "SHA": "sha256({})",
    "INT": "CAST({} AS bigint)",
}

FRAMES: dict[str, str] = {
    # Sessions: one per order; the customer decides repository and branch.
    "sessions": """
        SELECT concat('s', o_orderkey) AS session_id,
          CASE WHEN o_orderkey % 3 = 0 THEN 'codex' ELSE 'claude-code' END AS provider,
          CASE WHEN o_orderkey % 11 = 5 THEN concat('s', o_orderkey - 1) END AS parent_session_id,
          CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE concat('r', o_custkey % 25) END AS repo_id,
          MS[o_orderdate] + (o_orderkey % 1440) * 60000 AS started_ms,
          MS[o_orderdate] + (o_orderkey % 1440) * 60000 + (o_custkey % 600) * 60000 AS last_ms,
          CASE WHEN o_orderkey % 4 = 0
            THEN MS[o_orderdate] + (o_orderkey % 1440) * 60000 + (o_custkey % 600) * 60000 END AS ended_ms,
          CASE o_orderpriority WHEN '1-URGENT' THEN 'failed' WHEN '2-HIGH' THEN 'interrupted'
            WHEN '3-MEDIUM' THEN 'awaiting-user' WHEN '4-NOT SPECIFIED' THEN 'completed'
            ELSE 'unknown' END AS status,
          CASE o_custkey % 5 WHEN 0 THEN 'main' WHEN 1 THEN concat('feat/cust-', o_custkey % 400)
            WHEN 2 THEN concat('fix_c', o_custkey) END AS git_branch_start,
          CASE WHEN o_orderkey % 3 = 1 THEN concat('feat/cust-', o_custkey % 400) END AS git_branch_end,
          CASE WHEN o_orderkey % 6 = 0 THEN concat('Order ', o_orderkey, ' ', lower(o_orderpriority)) END AS title,
          CASE WHEN o_orderkey % 12 = 0 THEN 'observed' WHEN o_orderkey % 6 = 0 THEN 'generated' END AS title_provenance,
          CASE WHEN o_orderkey % 5 > 0 THEN INT[floor(o_totalprice)] END AS input_tokens,
          CASE WHEN o_orderkey % 5 > 0 THEN INT[floor(o_totalprice / 10)] END AS output_tokens,
          CASE WHEN o_orderkey % 5 > 0 THEN INT[floor(o_totalprice / 3)] END AS cached_tokens,
          CASE WHEN o_orderkey % 5 > 0 THEN 'complete' ELSE 'none' END AS usage_coverage,
          o_orderkey % 40 AS event_count, o_orderkey % 7 AS failure_count,
          o_orderkey % 9 AS changed_files
        FROM orders""",
    # Edit lines: one patch per (order, line number), one line per row of it.
    "patch_lines": """
        SELECT concat('p', l_orderkey, '-', l_linenumber) AS patch_id,
          concat('s', l_orderkey) AS session_id,
          CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE concat('r', o_custkey % 25) END AS repo_id,
          PATH[(l_orderkey * 7 + l_linenumber * 3) % 60] AS rel_path,
          MS[o_orderdate] + (o_orderkey % 1440) * 60000 + l_linenumber * 420000 AS ts_ms,
          CASE WHEN max(l_returnflag) = 'R' THEN 'removed' ELSE 'added' END AS side,
          lower(lpad(hex(l_partkey % 500), 16, '0')) AS fp,
          l_partkey % 500 AS ordinal
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        GROUP BY l_orderkey, l_linenumber, o_orderkey, o_custkey, o_orderdate, l_partkey % 500""",
    "patches": """
        SELECT patch_id, session_id, repo_id, rel_path, ts_ms,
          concat('/w/', coalesce(repo_id, 'none'), '/', rel_path) AS path,
          INT[sum(CASE WHEN side = 'added' THEN 1 ELSE 0 END)] AS added_raw,
          INT[sum(CASE WHEN side = 'removed' THEN 1 ELSE 0 END)] AS removed_raw
        FROM patch_lines GROUP BY patch_id, session_id, repo_id, rel_path, ts_ms""",
    # Commit lines: shipped rows of closed lines.
    "hits": """
        SELECT concat('r', o_custkey % 25) AS repo_id,
          PATH[(l_orderkey * 7 + l_linenumber * 3) % 60] AS rel_path,
          lower(lpad(hex(l_partkey % 500), 16, '0')) AS fp,
          concat('k', l_orderkey, '-', l_suppkey % 3) AS sha,
          MS[l_shipdate] + (l_partkey % 86400) * 1000 AS commit_ms,
          l_suppkey % 3 > 0 AS on_default
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE l_linestatus = 'F' AND l_returnflag <> 'R'""",
    "snapshots": """
        SELECT concat('r', o_custkey % 25) AS repo_id,
          PATH[(l_orderkey * 7 + l_linenumber * 3) % 60] AS rel_path,
          lower(lpad(hex(l_partkey % 500), 16, '0')) AS fp,
          CASE WHEN l_linestatus = 'O' OR l_partkey % 3 = 0 THEN 'worktree' ELSE 'head' END AS kind
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE l_suppkey % 2 = 0""",
    # Outcomes as stored rows for the read models (class and numbers straight from the lines).
    "outcomes": """
        SELECT concat('s', l_orderkey) AS session_id, concat('r', o_custkey % 25) AS repo_id,
          PATH[(l_orderkey * 7 + l_linenumber * 3) % 60] AS rel_path,
          CASE WHEN min(l_partkey) % 10 < 5 THEN 'landed' WHEN min(l_partkey) % 10 < 7 THEN 'uncommitted'
            WHEN min(l_partkey) % 10 = 7 THEN 'partial' WHEN min(l_partkey) % 10 = 8 THEN 'lost'
            ELSE 'unknown' END AS class,
          CASE WHEN min(l_partkey) % 10 > 4 THEN 'unknown' WHEN min(l_suppkey) % 5 = 0 THEN 'churned'
            WHEN min(l_suppkey) % 5 = 1 THEN 'reverted' ELSE 'surviving' END AS survival,
          INT[sum(l_quantity)] AS line_count,
          CASE WHEN min(l_partkey) % 10 < 5 THEN (min(l_partkey) * 977 + min(l_suppkey) * 331) % 200000 / 4.0E0 END AS commit_lag_seconds,
          CASE WHEN min(l_partkey) % 10 < 5 THEN concat('k', l_orderkey, '-', min(l_suppkey) % 3) END AS first_sha,
          CASE WHEN min(l_partkey) % 10 < 5 THEN max(MS[l_shipdate]) END AS first_commit_ms,
          CASE WHEN min(l_partkey) % 10 < 5 AND min(l_suppkey) % 2 = 0
            THEN concat('update part ', min(l_partkey)) END AS first_subject,
          CASE WHEN min(l_partkey) % 10 < 5 AND min(l_suppkey) % 4 = 0
            THEN concat('topic-', min(l_suppkey) % 8) END AS first_branch,
          CASE WHEN min(l_partkey) % 10 >= 5 OR min(l_suppkey) % 4 = 0 THEN 0.0E0 ELSE 1.0E0 END AS frac_on_default,
          1000000000000 AS computed_ms
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE o_orderkey % 50 <> 0
        GROUP BY l_orderkey, o_custkey, PATH[(l_orderkey * 7 + l_linenumber * 3) % 60]""",
    # Threads as stored rows: a customer's quarter.
    "members": """
        SELECT concat('s', o_orderkey) AS session_id,
          concat('t', o_custkey, '-', INT[floor(MS[o_orderdate] / 7776000000.0E0)]) AS thread_id
        FROM orders WHERE o_orderkey % 50 <> 0 AND o_orderkey % 8 <> 1""",
    "threads": """
        SELECT thread_id, max(repo_id) AS repo_id, count(*) AS sessions, min(started_ms) AS started_ms,
          max(last_ms) AS last_ms,
          CASE WHEN INT[sum(started_ms / 60000)] % 3 = 0 THEN max(git_branch_start) END AS branch,
          concat('Work ', thread_id) AS title,
          CASE INT[sum(started_ms / 60000)] % 4 WHEN 0 THEN 'landed' WHEN 1 THEN 'dangling'
            WHEN 2 THEN 'abandoned' ELSE 'unknown' END AS status
        FROM members JOIN sessions USING (session_id) GROUP BY thread_id""",
    "loops": """
        SELECT concat('lost-work:', session_id, ':', rel_path) AS loop_key, 'lost-work' AS type, repo_id,
          min(commit_lag_seconds) AS lag, INT[sum(line_count)] AS lines, INT[count(*)] AS files,
          INT[NULL] AS commits, CAST(NULL AS VARCHAR(20)) AS branch,
          1000000000000 - 86400000 * (INT[sum(line_count)] % 90) - length(session_id) * 1000 AS since_ms,
          CASE WHEN INT[sum(line_count)] % 5 = 0 THEN 'resolved' WHEN INT[sum(line_count)] % 5 = 1 THEN 'dismissed'
            ELSE 'open' END AS state,
          CASE WHEN INT[sum(line_count)] % 5 = 0 THEN 'user' END AS resolved_by
        FROM outcomes WHERE class IN ('lost', 'partial') GROUP BY session_id, repo_id, rel_path""",
    # Session events with calls, failures and ends, from the events table.
    "log_events": """
        SELECT event_id, concat('u', user_id, '-', INT[floor(MS[ts] / 604800000.0E0)]) AS session_id,
          concat('u', user_id) AS user_key, MS[ts] AS ts_ms, event_id AS seq,
          CASE WHEN event_type = 'view' THEN CASE K[props] % 4 WHEN 0 THEN 'prompt.submitted'
              WHEN 1 THEN 'tool.started' WHEN 2 THEN 'tool.completed' ELSE 'edit.applied' END
            WHEN event_type = 'click' THEN CASE K[props] % 2 WHEN 0 THEN 'command.started' ELSE 'command.completed' END
            WHEN event_type = 'error' THEN CASE WHEN K[props] % 5 = 0 THEN 'error' ELSE 'command.failed' END
            WHEN event_type = 'purchase' THEN 'turn.completed'
            ELSE CASE K[props] % 4 WHEN 0 THEN 'session.awaiting-user' WHEN 1 THEN 'agent.interrupted'
              WHEN 2 THEN 'approval.requested' ELSE 'session.ended' END END AS event_type,
          CASE WHEN event_type IN ('view', 'click', 'error', 'signup') AND K[props] % 7 > 0
            THEN concat('c', K[props] % 6) END AS call_id,
          CASE WHEN event_type = 'error' THEN 'failure' WHEN event_type = 'click' THEN 'success' END AS status,
          CASE WHEN event_type IN ('click', 'error') AND K[props] % 3 > 0 THEN concat('run ', K[props] % 10) END AS display,
          CASE WHEN event_type IN ('click', 'error') AND K[props] % 3 > 0 THEN 'run' END AS executable,
          CASE WHEN event_type IN ('click', 'error', 'view') THEN concat('tool', K[props] % 2) END AS tool_name,
          CASE WHEN event_type = 'view' THEN concat('/w/r/f', K[props] % 5, '.ts') END AS file_path,
          CASE WHEN K[props] % 2 = 0 THEN 'create' ELSE 'modify' END AS file_operation,
          CAST(NULL AS VARCHAR(20)) AS error_code,
          concat('v:', event_type) AS provider_event_type, 'claude-code' AS provider,
          INT[floor(value * 100)] AS tokens, K[props] AS k
        FROM events""",
    # A commit graph: customers are lines of work, the smallest one of a repository is its main.
    "commits": """
        SELECT concat('r', o_custkey % 25) AS repo_id, substring(SHA[concat('c', o_orderkey)], 1, 40) AS sha,
          concat('b', o_custkey) AS line, o_orderkey AS no, o_custkey % 25 = o_custkey AS on_main,
          MS[o_orderdate] + o_orderkey % 86400 * 1000 AS commit_ms, concat('order ', o_orderkey) AS subject,
          CASE WHEN o_orderkey % 13 = 0 THEN concat('Undo.', chr(10), 'This reverts commit ',
            substring(SHA[concat('c', o_orderkey - 7)], 1, CASE WHEN o_orderkey % 2 = 0 THEN 40 ELSE 9 END), '.') END AS body
        FROM orders""",
    "commit_parents": """
        SELECT repo_id, sha, parent_sha, 0 AS parent_no FROM (
          SELECT repo_id, sha, CASE WHEN commit_ms > main_ms
              THEN lag(sha) OVER (PARTITION BY repo_id ORDER BY commit_ms, no)
              ELSE lag(sha) OVER (PARTITION BY repo_id, line ORDER BY commit_ms, no) END AS parent_sha
          FROM (SELECT repo_id, sha, line, no, commit_ms,
            max(CASE WHEN on_main THEN commit_ms END) OVER (PARTITION BY repo_id) AS main_ms FROM commits) m) p
        WHERE parent_sha IS NOT NULL
        UNION ALL
        SELECT repo_id, sha, parent_sha, 1 AS parent_no FROM (
          SELECT repo_id, sha, no, lag(sha) OVER (PARTITION BY repo_id ORDER BY commit_ms, no) AS parent_sha
          FROM commits) q WHERE parent_sha IS NOT NULL AND no % 5 = 0""",
    "refs": """
        SELECT repo_id, CASE WHEN bool_or(on_main) THEN 'refs/heads/main' ELSE concat('refs/heads/', line) END AS ref,
          max_by(sha, commit_ms * 1000000 + no) AS sha, CAST(NULL AS VARCHAR(80)) AS target
        FROM commits GROUP BY repo_id, line
        UNION ALL
        SELECT repo_id, 'HEAD' AS ref, max_by(sha, commit_ms * 1000000 + no) AS sha,
          concat('refs/heads/', max_by(line, commit_ms * 1000000 + no)) AS target
        FROM commits GROUP BY repo_id""",
}
PATH = (
    "CASE ({0}) % 7 WHEN 0 THEN concat('src/a/f', {0}, '.ts') WHEN 1 THEN concat('docs/f', {0}, '.md') "
    "WHEN 2 THEN concat('tests/f', {0}, '.test.ts') WHEN 3 THEN concat('output/f', {0}, '.txt') "
    "WHEN 4 THEN concat('conf/f', {0}, '.json') WHEN 5 THEN concat('ui/f', {0}, '.tsx') "
    "ELSE concat('f', {0}, '.sql') END"
)
_TABLE_NAMES = re.compile(r"\b(FROM|JOIN)\s+([a-z_]+)\b")


def _spell(sql: str, engine: dict[str, str]) -> str:
    """Replaces NAME[argument] by the engine's spelling, innermost first."""
    spelled = {**engine, "PATH": PATH}
    pattern = re.compile(r"\b(" + "|".join(spelled) + r")\[([^\[\]]*)\]")
    while True:
        out = pattern.sub(lambda m: spelled[m.group(1)].replace("{}", m.group(2)).replace("{0}", m.group(2)), sql)
        if out == sql:
            return out
        sql = out


# Tables of long texts with the key that spreads them.
TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; long texts that arrive in fewer splits than there are cores are spread first.

    Only an input too small to fill the cores is moved; with more splits than cores, as on a
    cluster, texts stay where they are read.
    """
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if table in TEXT_KEYS and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores, TEXT_KEYS[table])
    return df


class Domain:
    """Frames of one data folder, built on demand as plain lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = load(self.spark, self.dir, name) if name in TABLES else self.sql(FRAMES[name])
        return self._made[name]

    def sql(self, text: str) -> DataFrame:
        """A binding-style SELECT over tables and frames, in Spark."""
        text = _spell(text, SPARK)
        names = {m.group(2) for m in _TABLE_NAMES.finditer(text)} & ({*TABLES} | FRAMES.keys())
        bound = _TABLE_NAMES.sub(
            lambda m: f"{m.group(1)} {{{m.group(2)}}} AS {m.group(2)}" if m.group(2) in names else m.group(0), text
        )
        return self.spark.sql(bound, **{n: getattr(self, n) for n in names})


def _needs(text: str, seen: list[str]) -> None:
    for m in _TABLE_NAMES.finditer(text):
        name = m.group(2)
        if name in FRAMES and name not in seen:
            _needs(FRAMES[name], seen)
            seen.append(name)


def duck(select: str, recursive: bool = False) -> str:
    """The SELECT with every frame it uses as a common table expression, in DuckDB's spelling."""
    used: list[str] = []
    _needs(select, used)
    body = select.strip()
    ctes = [f"{n} AS MATERIALIZED ({FRAMES[n]})" for n in used]
    if body.upper().startswith("WITH"):
        rest = re.sub(r"^WITH\s+(RECURSIVE\s+)?", "", body, flags=re.I)
        text = ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join([*ctes, ""]) + rest
    else:
        text = (f"WITH {', '.join(ctes)} " if ctes else "") + body
    return _spell(text, DUCK)

"""Edit outcomes, ownership, repository resolution, collisions and the commit graph."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from worklake.bindings import KEY, Domain
from worklake.operators import collisions as C
from worklake.operators import history as G
from worklake.operators import ingest as I
from worklake.operators import matching as M
from worklake.operators import threads as T
from worklake.operators.incremental import refresh_outcomes
from worklake.operators.ordered import checkpoint_dir, materialize
from worklake.plans.registry import Registry
from worklake.plans.text_queries import LINES, sql_fp, sql_significant
from worklake.sources.gitlog import edit_lines, snapshot_lines

HOUR = 3_600_000
EDIT_BASE = 1_704_067_200_000


def sql_outcomes(
    subject: str, lines: str, subjects: str, reverted: str | None = None, hits: str = "hits", snapshots: str = "snapshots"
) -> str:
    """Outcome rows from CTEs lines(subject, repo_id, rel_path, fp, ordinal, edit_ms), hits, snapshots."""
    gone = f"EXISTS (SELECT 1 FROM {reverted} g WHERE g.repo_id = o.repo_id AND g.sha = o.first.s)" if reverted else "false"
    return f"""
    perline AS (SELECT l.{subject}, l.repo_id, l.rel_path, l.fp, l.ordinal, l.edit_ms,
        coalesce(max(h.commit_ms) >= l.edit_ms - 120000, false) AS committed,
        coalesce(max(h.commit_ms) FILTER (h.on_default) >= l.edit_ms - 120000, false) AS on_default,
        min({{'t': h.commit_ms, 'o': l.ordinal, 's': h.sha}}) FILTER (h.commit_ms >= l.edit_ms - 120000) AS first
      FROM {lines} l LEFT JOIN {hits} h ON h.repo_id = l.repo_id AND h.rel_path = l.rel_path AND h.fp = l.fp
      GROUP BY l.{subject}, l.repo_id, l.rel_path, l.fp, l.ordinal, l.edit_ms),
    present AS (SELECT repo_id, rel_path, fp, bool_or(kind = 'worktree') AS in_tree, bool_or(kind = 'head') AS in_head
      FROM {snapshots} GROUP BY ALL),
    sums AS (SELECT {subject}, p.repo_id, p.rel_path, count(*) AS n, count(*) FILTER (committed) AS c, count(*) FILTER (on_default) AS d,
        count(*) FILTER (in_tree) AS t, count(*) FILTER (in_head) AS h, min(first) AS first
      FROM perline p LEFT JOIN present s ON s.repo_id = p.repo_id AND s.rel_path = p.rel_path AND s.fp = p.fp
      GROUP BY {subject}, p.repo_id, p.rel_path),
    o AS (SELECT s.*, coalesce(n, 0) AS n, c, d, t, h, first,
        CASE WHEN n IS NULL THEN 'unknown' WHEN c / n >= 0.5 THEN 'landed' WHEN ignored THEN 'unknown'
          WHEN t / n >= 0.5 THEN 'uncommitted' WHEN c > 0 OR t > 0 THEN 'partial' ELSE 'lost' END AS class
      FROM {subjects} s LEFT JOIN sums u ON u.{subject} = s.{subject} AND u.repo_id = s.repo_id AND u.rel_path = s.rel_path),
    outcome AS (SELECT {subject}, repo_id, rel_path, class, n AS line_count,
        CASE WHEN n = 0 THEN 'no-signal' WHEN class = 'unknown' THEN 'gitignored' END AS unknown_reason,
        CASE WHEN class = 'unknown' THEN 0.0 ELSE round(c / n, 6) END AS frac_committed,
        CASE WHEN class = 'unknown' THEN 0.0 ELSE round(d / n, 6) END AS frac_on_default,
        CASE WHEN class = 'unknown' THEN 0.0 ELSE round(t / n, 6) END AS frac_in_tree,
        CASE WHEN class = 'landed' THEN first.s END AS first_sha,
        CASE WHEN class = 'landed' THEN first.t END AS first_commit_ms,
        CASE WHEN class = 'landed' THEN round(greatest(0, first.t - edit_ms) / 1000, 6) END AS commit_lag_seconds,
        CASE WHEN class <> 'landed' THEN 'unknown' WHEN {gone} THEN 'reverted' WHEN h / n >= 0.5 THEN 'surviving'
          WHEN d / n >= 0.5 THEN 'churned' ELSE 'unknown' END AS survival
      FROM o)"""


OUTCOME_COLUMNS = [
    "class", "line_count", "unknown_reason", "frac_committed", "frac_on_default", "frac_in_tree",
    "first_sha", "first_commit_ms", "commit_lag_seconds", "survival",
]
DOC_SIDES = f"""{LINES},
    fps AS (SELECT d.doc_id, lang AS repo_id, 'corpus' AS rel_path, {sql_fp('n')} AS fp, min(pos) AS ordinal, {EDIT_BASE} + d.doc_id * {HOUR} AS at_ms
      FROM lines1 l JOIN documents d USING (doc_id) WHERE {sql_significant('n')} GROUP BY d.doc_id, lang, n),
    el AS (SELECT doc_id, repo_id, rel_path, fp, ordinal, at_ms AS edit_ms FROM fps WHERE doc_id % 2 = 0),
    dhits AS (SELECT repo_id, rel_path, fp, CAST(doc_id AS VARCHAR) AS sha, at_ms AS commit_ms, doc_id % 3 > 0 AS on_default FROM fps WHERE doc_id % 2 = 1 AND doc_id % 5 <> 0),
    dsnaps AS (SELECT repo_id, rel_path, fp, 'worktree' AS kind FROM fps WHERE doc_id % 2 = 1 AND doc_id % 5 = 0),
    su AS (SELECT doc_id, lang AS repo_id, 'corpus' AS rel_path, {EDIT_BASE} + doc_id * {HOUR} AS edit_ms, false AS ignored FROM documents WHERE doc_id % 2 = 0)"""
PATCH_LINES = """
    pl AS (SELECT patch_id, repo_id, rel_path, fp, ordinal, ts_ms AS edit_ms FROM patch_lines WHERE side = 'added' AND repo_id IS NOT NULL),
    ps AS (SELECT patch_id, repo_id, rel_path, ts_ms AS edit_ms, rel_path LIKE 'conf/%' AS ignored FROM patches WHERE repo_id IS NOT NULL),
    gone AS (SELECT DISTINCT repo_id, sha FROM hits WHERE sha LIKE '%7-1')"""
NET_LINES = """
    ranked AS (SELECT *, row_number() OVER (PARTITION BY session_id, repo_id, rel_path, fp ORDER BY ts_ms DESC, patch_id DESC, side = 'added' DESC) AS rn
      FROM patch_lines WHERE repo_id IS NOT NULL),
    fs AS (SELECT session_id, repo_id, rel_path, min(ts_ms) AS edit_ms, false AS ignored FROM patches WHERE repo_id IS NOT NULL GROUP BY 1, 2, 3),
    fl AS (SELECT r.session_id, r.repo_id, r.rel_path, fp, ordinal, edit_ms FROM ranked r
      JOIN fs USING (session_id, repo_id, rel_path) WHERE rn = 1 AND side = 'added')"""


def document_frames(d: Domain):
    """Even documents are edits, odd ones commits or working-tree files, on one hourly clock."""
    docs = d.documents.select(
        "doc_id", F.col("lang").alias("repo_id"), F.lit("corpus").alias("rel_path"),
        (F.lit(EDIT_BASE) + F.col("doc_id") * HOUR).alias("at_ms"), F.col("text").alias("content"),
    )
    keep = ["doc_id", "repo_id", "rel_path", "at_ms"]
    k = F.col("doc_id")
    edits = docs.where(k % 2 == 0)
    # Fingerprints are tables of the model: hashed once, then read by every step of the match.
    lines = materialize(edit_lines(edits, KEY, keep).withColumnRenamed("at_ms", "edit_ms"), "lines")
    hits = edit_lines(docs.where((k % 2 == 1) & (k % 5 != 0)), KEY, keep).select(
        "repo_id", "rel_path", "fp", k.cast("string").alias("sha"), F.col("at_ms").alias("commit_ms"),
        (k % 3 > 0).alias("on_default"),
    )
    hits = materialize(hits, "hits")
    tree = snapshot_lines(
        docs.where((k % 2 == 1) & (k % 5 == 0)).withColumn("kind", F.lit("worktree")), KEY
    )
    subjects = edits.select(
        "doc_id", "repo_id", "rel_path", F.col("at_ms").alias("edit_ms"), F.lit(False).alias("ignored")
    )
    return subjects, lines, hits, tree


def patch_frames(d: Domain):
    lines = d.patch_lines.where("side = 'added' and repo_id is not null").select(
        "patch_id", "repo_id", "rel_path", "fp", "ordinal", F.col("ts_ms").alias("edit_ms")
    )
    subjects = d.patches.where("repo_id is not null").select(
        "patch_id", "repo_id", "rel_path", F.col("ts_ms").alias("edit_ms"),
        F.col("rel_path").startswith("conf/").alias("ignored"),
    )
    reverted = d.hits.where("sha like '%7-1'").select("repo_id", "sha").distinct()
    return subjects, lines, reverted


def collision_frames(d: Domain, repos: int = 5, files: int = 20, fps: int = 20):
    """A denser world: few repositories and files, so that sessions do meet."""
    lines = d.sql(f"""
        SELECT concat('p', l_orderkey, '-', l_linenumber) AS patch_id, concat('s', o_custkey % 300, '-', o_orderkey % 4) AS session_id,
          concat('r', o_custkey % {repos}) AS repo_id, concat('f', (l_orderkey * 7 + l_linenumber) % {files}) AS rel_path,
          MS[o_orderdate] + (o_orderkey % 96) * 900000 + l_linenumber * 120000 AS ts_ms,
          CASE WHEN max(l_returnflag) = 'R' THEN 'removed' ELSE 'added' END AS side,
          concat('x', l_partkey % {fps}) AS fp
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        GROUP BY l_orderkey, l_linenumber, o_orderkey, o_custkey, o_orderdate, l_partkey % {fps}""")
    patches = lines.select("patch_id", "session_id", "repo_id", "rel_path", "ts_ms").distinct()
    sessions = patches.groupBy("session_id").agg(
        F.min("ts_ms").alias("started_ms"), F.max("ts_ms").alias("last_ms")
    ).withColumn(
        "parent_session_id",
        F.when(F.col("session_id").endswith("-3"), F.regexp_replace("session_id", "-3$", "-0")),
    ).where("not session_id like 's7%'")
    landed = patches.where("substring(rel_path, 2, 3) in ('3', '11')").select("session_id", "rel_path").distinct()
    return patches, lines, sessions, landed


SQL_COLLISIONS = """
    cl AS (SELECT concat('p', l_orderkey, '-', l_linenumber) AS patch_id, concat('s', o_custkey % 300, '-', o_orderkey % 4) AS session_id,
          concat('r', o_custkey % 5) AS repo_id, concat('f', (l_orderkey * 7 + l_linenumber) % 20) AS rel_path,
          MS[o_orderdate] + (o_orderkey % 96) * 900000 + l_linenumber * 120000 AS ts_ms,
          CASE WHEN max(l_returnflag) = 'R' THEN 'removed' ELSE 'added' END AS side, concat('x', l_partkey % 20) AS fp
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        GROUP BY l_orderkey, l_linenumber, o_orderkey, o_custkey, o_orderdate, l_partkey % 20),
    cp AS (SELECT DISTINCT patch_id, session_id, repo_id, rel_path, ts_ms FROM cl),
    cs AS (SELECT session_id, min(ts_ms) AS started_ms, max(ts_ms) AS last_ms,
        CASE WHEN session_id LIKE '%-3' THEN regexp_replace(session_id, '-3$', '-0') END AS parent FROM cp GROUP BY session_id HAVING NOT session_id LIKE 's7%'),
    over AS (SELECT x.patch_id AS pa, y.patch_id AS pb, count(*) AS lines FROM cl x JOIN cl y ON x.repo_id = y.repo_id AND x.rel_path = y.rel_path AND x.fp = y.fp
      AND x.side = 'added' AND y.side = 'removed' AND y.ts_ms >= x.ts_ms AND y.ts_ms - x.ts_ms <= 604800000 GROUP BY 1, 2),
    pairs AS (SELECT a.repo_id, a.rel_path, a.patch_id AS pa, b.patch_id AS pb, a.session_id AS session_a, b.session_id AS session_b, a.ts_ms AS ta, b.ts_ms AS tb,
        coalesce(w.lines, 0) AS lines,
        coalesce(sa.started_ms, -9e17) <= coalesce(sb.last_ms, 9e17) AND coalesce(sb.started_ms, -9e17) <= coalesce(sa.last_ms, 9e17) AS overlap
      FROM cp a JOIN cp b ON a.repo_id = b.repo_id AND a.rel_path = b.rel_path AND (a.ts_ms, a.patch_id) < (b.ts_ms, b.patch_id) AND b.ts_ms - a.ts_ms <= 604800000
      LEFT JOIN cs sa ON sa.session_id = a.session_id LEFT JOIN cs sb ON sb.session_id = b.session_id
      LEFT JOIN over w ON w.pa = a.patch_id AND w.pb = b.patch_id
      WHERE a.session_id <> b.session_id AND coalesce(sa.parent <> b.session_id, true) AND coalesce(sb.parent <> a.session_id, true)
        AND coalesce(sa.parent <> sb.parent, true)),
    marked AS (SELECT *, lines > 0 AND substring(rel_path, 2, 3) NOT IN ('3', '11') AS over, tb - ta <= 3600000 AND overlap AS con FROM pairs),
    found AS (SELECT CASE WHEN over THEN 'overwrite' ELSE 'concurrent-edit' END AS kind, * FROM marked WHERE over OR con),
    firsts AS (SELECT kind, repo_id, rel_path, session_a, session_b, min(ta) AS start_ms,
        arg_min({'tb': tb, 'ta': ta, 'lines': lines}, {'tb': tb, 'pb': pb, 'ta': -ta}) AS f, max(ta) AS x
      FROM found GROUP BY ALL),
    result AS (SELECT kind, repo_id, rel_path, session_a, session_b, start_ms, f.tb AS end_ms,
        CASE WHEN kind = 'overwrite' THEN f.lines END AS overwritten_lines,
        CASE WHEN kind <> 'overwrite' THEN CAST(floor((f.tb - f.ta) / 60000 + 0.5) AS BIGINT) END AS minutes_apart FROM firsts)"""


#: Sessions in order with their qualifying candidates, and the walk that picks a predecessor for one after the other.
SQL_LINKS = """
    s AS (SELECT x.session_id, coalesce(x.repo_id, p.repo_id) AS repo_id, x.parent_session_id, x.started_ms, x.last_ms, x.git_branch_start AS b1, x.git_branch_end AS b2,
        p.started_ms AS pstart
      FROM sessions x LEFT JOIN sessions p ON p.session_id = x.parent_session_id
      WHERE coalesce(x.repo_id, p.repo_id) IS NOT NULL),
    uses AS (SELECT session_id, repo_id, started_ms, last_ms, unnest([b1, b2]) AS branch, unnest([0, 1]) AS branch_no FROM s),
    spans AS (SELECT repo_id, branch FROM uses WHERE branch IS NOT NULL AND branch NOT IN ('HEAD', 'main') GROUP BY 1, 2 HAVING max(last_ms) - min(started_ms) <= 1209600000),
    wb AS (SELECT session_id, u.branch, min(branch_no) AS branch_no FROM uses u JOIN spans USING (repo_id, branch) GROUP BY 1, 2),
    files AS (SELECT DISTINCT session_id, rel_path FROM patches), sizes AS (SELECT session_id, count(*) AS n FROM files GROUP BY 1),
    added AS (SELECT DISTINCT session_id, fp FROM patch_lines WHERE side = 'added'), removed AS (SELECT DISTINCT session_id, fp FROM patch_lines WHERE side = 'removed'),
    pairs AS (SELECT s.session_id, c.session_id AS cand, c.started_ms AS cstart FROM s JOIN s c ON c.repo_id = s.repo_id
        AND (c.started_ms < s.started_ms OR (c.started_ms = s.started_ms AND c.session_id > s.session_id)) AND s.started_ms - c.last_ms <= 259200000),
    shared AS (SELECT p.session_id, cand, count(*) AS n FROM pairs p JOIN files a ON a.session_id = p.session_id JOIN files b ON b.session_id = cand AND b.rel_path = a.rel_path GROUP BY 1, 2),
    good AS (SELECT p.session_id, cand FROM pairs p JOIN wb a ON a.session_id = p.session_id JOIN wb b ON b.session_id = cand AND b.branch = a.branch
      UNION SELECT p.session_id, cand FROM pairs p JOIN removed a ON a.session_id = p.session_id JOIN added b ON b.session_id = cand AND b.fp = a.fp
      UNION SELECT h.session_id, cand FROM shared h JOIN sizes x ON x.session_id = h.session_id JOIN sizes y ON y.session_id = cand WHERE h.n / (x.n + y.n - h.n) >= 0.3),
    inorder AS (SELECT session_id, repo_id, started_ms, CASE WHEN parent_session_id IN (SELECT session_id FROM s) AND (pstart < started_ms OR (pstart = started_ms AND parent_session_id > s.session_id)) THEN parent_session_id END AS parent
      FROM s)"""
#: A session is settled once all it may follow are; those that just were settled (walk) make others ready.
SQL_THREADS = f"""{SQL_LINKS},
    deps AS (SELECT session_id, started_ms, parent AS dep, CAST(0 AS BIGINT) AS cstart, true AS is_parent FROM inorder WHERE parent IS NOT NULL
      UNION ALL SELECT o.session_id, o.started_ms, cand, cstart, false FROM inorder o JOIN pairs USING (session_id) JOIN good USING (session_id, cand) WHERE parent IS NULL),
    totals AS (SELECT session_id, count(*) AS n FROM deps GROUP BY 1),
    walk(session_id, pred, root, t) USING KEY (session_id) AS (
      SELECT session_id, CAST(NULL AS VARCHAR), session_id, started_ms FROM inorder WHERE session_id NOT IN (SELECT session_id FROM deps)
      UNION
      SELECT session_id, f.dep, coalesce(f.root, session_id), coalesce(f.t, started_ms) FROM (
        SELECT d.session_id, any_value(d.started_ms) AS started_ms, count(*) AS n,
          arg_min({{'dep': d.dep, 'root': r.root, 't': r.t}}, {{'s': -d.cstart, 'c': d.dep}}) FILTER (d.is_parent OR d.started_ms - r.t <= 604800000) AS f
        FROM deps d JOIN recurring.walk r ON r.session_id = d.dep
        WHERE d.session_id IN (SELECT x.session_id FROM walk w JOIN deps x ON x.dep = w.session_id) GROUP BY d.session_id) AS ready
      JOIN totals USING (session_id, n))"""


SELF_CHECK = f"""{PATCH_LINES},
        files AS (SELECT DISTINCT repo_id, rel_path FROM pl),
        f(rel_path, i, h) AS (SELECT DISTINCT rel_path, 0, CAST(2166136261 AS BIGINT) FROM files
          UNION ALL SELECT rel_path, i + 1, (xor(h, CAST(unicode(substring(rel_path, i + 1, 1)) AS BIGINT)) * 16777619) & 4294967295 FROM f WHERE i < length(rel_path)),
        ranked AS (SELECT repo_id, rel_path, row_number() OVER (PARTITION BY repo_id ORDER BY rel_path) - 1 AS pos, count(*) OVER (PARTITION BY repo_id) AS n FROM files),
        other AS (SELECT r.repo_id, r.rel_path, o.rel_path AS other_path FROM ranked r JOIN f ON f.rel_path = r.rel_path AND f.i = length(r.rel_path)
          JOIN ranked o ON o.repo_id = r.repo_id AND o.pos = CASE WHEN f.h % r.n = r.pos THEN (f.h % r.n + 1) % r.n ELSE f.h % r.n END WHERE r.n > 1),
        per AS (SELECT pl.repo_id, patch_id, avg(CASE WHEN EXISTS (SELECT 1 FROM hits h WHERE h.repo_id = pl.repo_id AND h.rel_path = pl.rel_path AND h.fp = pl.fp AND h.commit_ms < edit_ms - 120000) THEN 1 ELSE 0 END) AS a,
            avg(CASE WHEN EXISTS (SELECT 1 FROM hits h WHERE h.repo_id = pl.repo_id AND h.rel_path = o.other_path AND h.fp = pl.fp AND h.commit_ms >= edit_ms - 120000) THEN 1 ELSE 0 END) AS b
          FROM pl JOIN other o ON o.repo_id = pl.repo_id AND o.rel_path = pl.rel_path GROUP BY 1, 2),
        c AS (SELECT repo_id, avg(CASE WHEN a >= 0.5 THEN 1 ELSE 0 END) AS control_a, avg(CASE WHEN b >= 0.5 THEN 1 ELSE 0 END) AS control_b, count(*) AS sample FROM per GROUP BY 1),
        checks AS (SELECT repo_id, round(control_a, 6) AS control_a, round(control_b, 6) AS control_b, sample,
          CASE WHEN sample >= 20 AND (control_a > 0.08 OR control_b > 0.01) THEN 'low' ELSE 'normal' END AS confidence FROM c)"""


def register(q: Registry) -> None:
    @q.add("A01_classify_edits", f"WITH {DOC_SIDES}, {sql_outcomes('doc_id', 'el', 'su', None, 'dhits', 'dsnaps')} SELECT doc_id, {', '.join(OUTCOME_COLUMNS)} FROM outcome")
    def _(d):
        subjects, lines, hits, tree = document_frames(d)
        out = M.classify(subjects, lines, hits, tree, ["doc_id"])
        return out.select("doc_id", *OUTCOME_COLUMNS)

    @q.add(
        "A01_A02_patch_outcomes",
        f"""WITH {PATCH_LINES}, floors AS (SELECT repo_id, min(edit_ms) - 86400000 AS floor_ms FROM pl GROUP BY repo_id),
          since AS (SELECT h.* FROM hits h JOIN floors f ON f.repo_id = h.repo_id WHERE h.commit_ms >= floor_ms),
          {sql_outcomes('patch_id', 'pl', 'ps', 'gone', 'since')} SELECT patch_id, {', '.join(OUTCOME_COLUMNS)} FROM outcome""",
    )
    def _(d):
        subjects, lines, reverted = patch_frames(d)
        lines = materialize(lines, "lines")
        hits = M.since_first_edit(M.touched_only(d.hits, lines), lines)
        return M.classify(subjects, lines, hits, d.snapshots, ["patch_id"], reverted).select("patch_id", *OUTCOME_COLUMNS)

    @q.add(
        "A03_net_session_files",
        f"WITH {NET_LINES}, fl2 AS (SELECT session_id || '|' || repo_id || '|' || rel_path AS k, * FROM fl), fs2 AS (SELECT session_id || '|' || repo_id || '|' || rel_path AS k, * FROM fs), "
        f"{sql_outcomes('k', 'fl2', 'fs2')} SELECT k, {', '.join(OUTCOME_COLUMNS)} FROM outcome",
    )
    def _(d):
        inside = "repo_id is not null"
        subjects = M.session_file_subjects(d.patches.where(inside)).withColumn("ignored", F.lit(False))
        key = ["session_id", "repo_id", "rel_path"]
        lines = M.net_session_file(d.patch_lines.where(inside)).join(subjects.select(*key, "edit_ms"), key)
        out = M.classify(subjects, lines, d.hits, d.snapshots, key)
        return out.select(F.concat_ws("|", *key).alias("k"), *OUTCOME_COLUMNS)

    @q.add(
        "A04_unknown_reasons",
        """WITH repos AS (SELECT DISTINCT repo_id FROM patches WHERE repo_id IS NOT NULL)
        SELECT CASE WHEN repo_id IS NULL THEN 'outside-repo' WHEN repo_id IN ('r3', 'r4') THEN 'repo-missing' ELSE 'git-error' END AS reason, count(*) AS n
        FROM patches WHERE repo_id IS NULL OR repo_id IN ('r3', 'r4', 'r5') GROUP BY 1""",
    )
    def _(d):
        from worklake.plans.views import unknown_reasons

        repos = d.patches.where("repo_id is not null").select("repo_id").distinct().select(
            "repo_id", F.col("repo_id").isin("r3", "r4").alias("missing"), (F.col("repo_id") == "r5").alias("failed")
        )
        return unknown_reasons(M.unknown_outcomes(d.patches, repos))

    @q.add(
        "A05_self_check",
        f"WITH RECURSIVE {SELF_CHECK} SELECT * FROM checks",
        recursive=True,
    )
    def _(d):
        _, lines, _ = patch_frames(d)
        return M.self_check(lines, d.hits)

    @q.add(
        "A24_changed_repos",
        "SELECT DISTINCT repo_id FROM patches WHERE repo_id IN ('r1', 'r2', 'r3')",
    )
    def _(d):
        refs = d.refs.select("repo_id", "ref", "sha")
        files = d.patches.where("repo_id is not null").select(
            "repo_id", "rel_path", F.length("rel_path").alias("size"), F.lit(1).alias("mtime_ms")
        ).distinct()
        patches = d.patches.where("repo_id is not null")
        before = M.input_keys(patches, refs, files, "v1")
        # One repository gets a new ref, one an edit, one a touched file.
        refs2 = refs.withColumn("sha", F.when((F.col("repo_id") == "r1") & (F.col("ref") == "HEAD"), "new").otherwise(F.col("sha")))
        patches2 = patches.withColumn("patch_id", F.when(F.col("repo_id") == "r2", F.concat("patch_id", F.lit("x"))).otherwise(F.col("patch_id")))
        files2 = files.withColumn("mtime_ms", F.when(F.col("repo_id") == "r3", 2).otherwise(F.col("mtime_ms")))
        return M.changed_repos(M.input_keys(patches2, refs2, files2, "v1"), before).select("repo_id")

    @q.add(
        "A24_incremental_outcomes",
        f"WITH {PATCH_LINES}, {sql_outcomes('patch_id', 'pl', 'ps')} SELECT patch_id, repo_id, {', '.join(OUTCOME_COLUMNS)} FROM outcome",
    )
    def _(d):
        # A first run lacks some edits of three repositories and has one that is gone afterwards; the second replaces just those.
        store = f"{checkpoint_dir(d.spark)}/outcomes-{uuid.uuid4().hex}"
        subjects, lines, _ = patch_frames(d)
        refs = d.refs.select("repo_id", "ref", "sha")
        files = d.patches.where("repo_id is not null").select("repo_id", "rel_path", F.lit(1).alias("size"), F.lit(1).alias("mtime_ms")).distinct()
        late = F.col("repo_id").isin("r1", "r2", "r3") & F.col("patch_id").endswith("-1")
        extra = subjects.where("repo_id = 'r4'").withColumn("repo_id", F.lit("gone/r"))
        inputs = (lines, d.hits, d.snapshots, refs, files, ["patch_id"])
        refresh_outcomes(d.spark, store, subjects.where(~late).unionByName(extra), *inputs)
        refresh_outcomes(d.spark, store, subjects, *inputs)
        return d.spark.read.parquet(f"{store}/outcomes").select("patch_id", "repo_id", *OUTCOME_COLUMNS)

    @q.add(
        "J01_copied_history",
        """WITH ev AS (SELECT event_id, session_id, ts_ms, event_type, call_id, provider_event_type,
            CASE WHEN k % 3 > 0 THEN 'x' || (tokens % 900) END AS vid FROM log_events),
        keyed AS (SELECT *, CASE WHEN vid IS NOT NULL THEN 'e|' || vid || '|' || event_type || '|' || coalesce(call_id, '')
            ELSE 't|' || (ts_ms // 3600000) || '|' || provider_event_type || '|' || event_type END AS key FROM ev),
        own AS (SELECT key, arg_min(session_id, (ts_ms, event_id)) AS owner FROM keyed GROUP BY key)
        SELECT event_id FROM keyed JOIN own USING (key) WHERE session_id = owner""",
    )
    def _(d):
        ev = d.log_events.withColumn(
            "provider_event_id", F.when(F.col("k") % 3 > 0, F.concat(F.lit("x"), F.col("tokens") % 900))
        )
        real = ev.withColumnRenamed("ts_ms", "real_ms").withColumn("ts_ms", F.floor(F.col("real_ms") / 3_600_000))
        return I.drop_copies(real, I.event_copy_key(), ["real_ms", "event_id"]).select("event_id")

    @q.add(
        "J01_copies_against_stored",
        """WITH u AS (SELECT event_id, session_id, ts_ms, 'm' || (tokens % 1500) AS key FROM log_events),
        stored AS (SELECT DISTINCT key, session_id FROM u WHERE event_id % 10 = 0),
        own AS (SELECT key, arg_min(session_id, (ts_ms, event_id)) AS owner FROM u GROUP BY key)
        SELECT event_id FROM u JOIN own USING (key) WHERE CASE WHEN key IN (SELECT key FROM stored)
          THEN EXISTS (SELECT 1 FROM stored s WHERE s.key = u.key AND s.session_id = u.session_id) ELSE session_id = owner END""",
    )
    def _(d):
        u = d.log_events.withColumn("usage_key", F.concat(F.lit("m"), F.col("tokens") % 1500))
        owners = u.where("event_id % 10 = 0").select("provider", I.usage_copy_key().alias("key"), "session_id")
        return I.drop_copies(u, I.usage_copy_key(), ["ts_ms", "event_id"], owners).select("event_id")

    @q.add(
        "J02_path_to_repo",
        """WITH p AS (SELECT page_id, '/' || regexp_replace(url, '^https?://', '') AS path FROM pages),
        r AS (SELECT DISTINCT regexp_extract(path, '^(/[^/]+)/', 1) AS root FROM p WHERE page_id % 3 > 0
          UNION SELECT DISTINCT regexp_extract(path, '^(/[^/]+/[^/]+)/', 1) FROM p WHERE page_id % 5 = 0)
        SELECT page_id, arg_max(root, length(root)) AS root_path FROM p LEFT JOIN (SELECT * FROM r WHERE root <> '') x ON starts_with(path, root || '/') GROUP BY page_id""",
    )
    def _(d):
        p = d.pages.select("page_id", F.concat(F.lit("/"), F.regexp_replace("url", "^https?://", "")).alias("path"))
        roots = lambda rows, pattern: rows.select(F.regexp_extract("path", pattern, 1).alias("root_path"))
        repos = roots(p.where("page_id % 3 > 0"), "^(/[^/]+)/").union(
            roots(p.where("page_id % 5 = 0"), "^(/[^/]+/[^/]+)/")
        ).where("root_path <> ''").distinct().withColumn("repo_id", F.md5("root_path"))
        return p.join(I.resolve_repos(p, repos), "path").select("page_id", "root_path")

    @q.add(
        "J02_place_patches",
        """SELECT patch_id, CASE WHEN ordinal % 3 = 0 THEN NULL ELSE 'r' || (ordinal % 3) END AS repo_id,
          CASE WHEN ordinal % 3 = 0 THEN NULL ELSE rel_path END AS rel_path FROM (
          SELECT patch_id, rel_path, CAST(sum(ordinal) AS BIGINT) AS ordinal FROM patch_lines GROUP BY 1, 2)""",
    )
    def _(d):
        # Repository r1 encloses its paths; r2 is only known through the session.
        k = F.col("k") % 3
        p = d.patch_lines.groupBy("patch_id", "rel_path").agg(F.sum("ordinal").alias("k"))
        p = p.select(
            "patch_id", F.concat(F.lit("z"), k.cast("string")).alias("session_id"),
            F.concat(F.when(k == 1, "/a/one/").when(k == 2, "/b/two/").otherwise("/c/"), "rel_path").alias("path"),
        )
        repos = p.sparkSession.createDataFrame([("r1", "/a/one"), ("r2", "/b/two")], "repo_id string, root_path string")
        sessions = p.select("session_id").distinct().withColumn(
            "repo_root", F.when(F.col("session_id") == "z2", "/b/two").when(F.col("session_id") == "z1", "/b/two")
        )
        return I.place_patches(p, repos, sessions).select("patch_id", "repo_id", "rel_path")

    @q.add(
        "J03_edit_commit_match",
        f"""WITH {PATCH_LINES} SELECT pl.patch_id, pl.fp, coalesce(max(h.commit_ms) >= pl.edit_ms - 120000, false) AS committed,
          coalesce(max(h.commit_ms) FILTER (h.on_default) >= pl.edit_ms - 120000, false) AS on_default,
          min(h.commit_ms) FILTER (h.commit_ms >= pl.edit_ms - 120000) AS first_ms,
          coalesce(min(h.commit_ms) < pl.edit_ms - 120000, false) AS before
        FROM pl LEFT JOIN hits h ON h.repo_id = pl.repo_id AND h.rel_path = pl.rel_path AND h.fp = pl.fp GROUP BY pl.patch_id, pl.fp, pl.edit_ms""",
    )
    def _(d):
        _, lines, _ = patch_frames(d)
        m = M.match_commits(lines, d.hits)
        return m.select("patch_id", "fp", "committed", "on_default", F.col("first_hit.commit_ms").alias("first_ms"), "before")

    @q.add(
        "J04_lines_in_snapshots",
        f"""WITH {PATCH_LINES} SELECT patch_id, fp, EXISTS (SELECT 1 FROM snapshots s WHERE s.repo_id = pl.repo_id AND s.rel_path = pl.rel_path AND s.fp = pl.fp AND kind = 'worktree') AS in_tree,
          EXISTS (SELECT 1 FROM snapshots s WHERE s.repo_id = pl.repo_id AND s.rel_path = pl.rel_path AND s.fp = pl.fp AND kind = 'head') AS in_head FROM pl""",
    )
    def _(d):
        _, lines, _ = patch_frames(d)
        return M.match_snapshots(lines, d.snapshots).select("patch_id", "fp", "in_tree", "in_head")

    @q.add("J08_J09_latest_candidates", f"WITH RECURSIVE {SQL_THREADS} SELECT session_id, pred FROM walk", recursive=True)
    def _(d):
        return T.link_sessions(d.sessions, d.patches, d.patch_lines, main_branches(d)).select("session_id", "pred")

    @q.add(
        "J08_J09_similar_sessions",
        """WITH files AS (SELECT DISTINCT p.repo_id, p.session_id, rel_path FROM patches p JOIN sessions s ON s.session_id = p.session_id AND s.repo_id = p.repo_id),
        sizes AS (SELECT session_id, count(*) AS n FROM files GROUP BY 1),
        shared AS (SELECT a.session_id, b.session_id AS candidate, count(*) AS shared_files FROM files a JOIN files b ON b.repo_id = a.repo_id AND b.rel_path = a.rel_path GROUP BY 1, 2)
        SELECT h.session_id, candidate, shared_files, round(shared_files / (x.n + y.n - shared_files), 6) AS jaccard
        FROM shared h JOIN sizes x ON x.session_id = h.session_id JOIN sizes y ON y.session_id = candidate
          JOIN sessions s ON s.session_id = h.session_id JOIN sessions c ON c.session_id = candidate
        WHERE (c.started_ms < s.started_ms OR (c.started_ms = s.started_ms AND c.session_id > s.session_id))
          AND s.started_ms - c.last_ms <= 259200000 AND shared_files / (x.n + y.n - shared_files) >= 0.3""",
    )
    def _(d):
        sessions = d.sessions.where("repo_id is not null")
        found = T.similar_sessions(sessions, d.patches)
        return found.withColumn("jaccard", F.round("jaccard", 6))

    @q.add("J10_J13_D06_collisions", f"WITH {SQL_COLLISIONS} SELECT * FROM result WHERE kind = 'overwrite' OR NOT EXISTS (SELECT 1 FROM result o WHERE o.kind = 'overwrite' AND o.repo_id = result.repo_id AND o.rel_path = result.rel_path AND o.session_a = result.session_a AND o.session_b = result.session_b)")
    def _(d):
        return C.detect_collisions(*collision_frames(d)).drop("collision_key")

    @q.add(
        "J15_session_threads",
        "SELECT s.session_id, thread_id FROM sessions s LEFT JOIN members USING (session_id)",
    )
    def _(d):
        return d.sessions.join(d.members, "session_id", "left").select("session_id", "thread_id")

    @q.add(
        "J17_patch_outcomes_by_repo",
        f"""WITH {PATCH_LINES}, {sql_outcomes('patch_id', 'pl', 'ps')} SELECT s.provider, o.repo_id, class, count(*) AS n FROM outcome o
          JOIN patches p ON p.patch_id = o.patch_id JOIN sessions s ON s.session_id = p.session_id GROUP BY ALL""",
    )
    def _(d):
        subjects, lines, _ = patch_frames(d)
        out = M.classify(subjects, lines, d.hits, d.snapshots, ["patch_id"])
        repos = d.patches.select("repo_id").distinct()
        return (
            out.join(d.patches.select("patch_id", "session_id"), "patch_id")
            .join(d.sessions.select("session_id", "provider"), "session_id")
            .join(repos, "repo_id")
            .groupBy("provider", "repo_id", "class")
            .agg(F.count("*").alias("n"))
        )

    @q.add(
        "J22_leak_audit",
        """WITH s AS (SELECT item_id, text AS snippet FROM benchmark)
        SELECT item_id, doc_id FROM s JOIN documents ON contains(text, snippet) WHERE length(snippet) >= 24
          AND len(list_filter(string_split_regex(trim(snippet), '\\s+'), lambda w: w <> '')) >= 3""",
    )
    def _(d):
        from worklake.operators.search import find_snippets, prose_snippets

        snippets = prose_snippets(d.benchmark, "text", ["item_id"])
        return find_snippets(snippets, d.documents.select("doc_id", "text"), "text", "doc_id").select("item_id", "doc_id")

    register_graph(q)


def main_branches(d: Domain):
    return d.sessions.where("repo_id is not null").select("repo_id").distinct().withColumn(
        "default_branch", F.lit("origin/main")
    )


REACH = """
    tips AS (SELECT repo_id, sha FROM refs WHERE ref = 'refs/heads/main'),
    reach(repo_id, sha) AS (SELECT repo_id, sha FROM tips
      UNION SELECT p.repo_id, p.parent_sha FROM reach r JOIN commit_parents p ON p.repo_id = r.repo_id AND p.sha = r.sha)"""


def register_graph(q: Registry) -> None:
    @q.add("G04_on_default_branch", f"WITH RECURSIVE {REACH} SELECT repo_id, sha FROM reach", recursive=True)
    def _(d):
        return G.on_default(d.refs, d.commit_parents, G.history_index(d.commit_parents, d.commits))

    @q.add(
        "G05_default_branch",
        """SELECT repo_id, coalesce(max('main') FILTER (ref = 'refs/heads/main'), max(regexp_replace(target, '^refs/heads/', '')) FILTER (ref = 'HEAD')) AS default_branch
          FROM refs GROUP BY repo_id""",
    )
    def _(d):
        return G.default_branch(d.refs)

    @q.add(
        "G06_working_trunk",
        """WITH RECURSIVE head AS (SELECT repo_id, sha, regexp_replace(target, '^refs/heads/', '') AS name FROM refs WHERE ref = 'HEAD'),
        up(repo_id, side, sha) AS (SELECT repo_id, 'head', sha FROM head UNION ALL SELECT repo_id, 'main', sha FROM refs WHERE ref = 'refs/heads/main'
          UNION SELECT p.repo_id, side, p.parent_sha FROM up r JOIN commit_parents p ON p.repo_id = r.repo_id AND p.sha = r.sha),
        own AS (SELECT repo_id, max(commit_ms) - min(commit_ms) AS span FROM up JOIN commits USING (repo_id, sha) WHERE side = 'head'
          AND NOT EXISTS (SELECT 1 FROM up m WHERE m.side = 'main' AND m.repo_id = up.repo_id AND m.sha = up.sha) GROUP BY 1)
        SELECT h.repo_id, h.name AS working_trunk FROM head h JOIN own USING (repo_id) WHERE span > 1209600000 AND name <> 'main'
          AND EXISTS (SELECT 1 FROM refs t JOIN up ON up.repo_id = t.repo_id AND up.sha = t.sha AND up.side = 'head' WHERE t.ref = 'refs/heads/main' AND t.repo_id = h.repo_id)""",
        recursive=True,
    )
    def _(d):
        return G.working_trunk(d.refs, d.commit_parents, d.commits)

    @q.add(
        "G07_branch_of_commits",
        f"""WITH RECURSIVE {REACH}, lab(repo_id, sha, branch) AS (SELECT repo_id, sha, regexp_replace(ref, '^refs/heads/', '') FROM refs
            WHERE ref LIKE 'refs/heads/%' AND (repo_id, sha) NOT IN (SELECT (repo_id, sha) FROM reach)
          UNION SELECT p.repo_id, p.parent_sha, branch FROM lab l JOIN commit_parents p ON p.repo_id = l.repo_id AND p.sha = l.sha
            WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.repo_id = p.repo_id AND r.sha = p.parent_sha))
        SELECT repo_id, sha, min(branch) AS branch FROM lab GROUP BY 1, 2""",
        recursive=True,
    )
    def _(d):
        return G.branch_of(d.refs, d.commit_parents)

    @q.add(
        "G08_J19_reverted_commits",
        """WITH c AS (SELECT DISTINCT repo_id, regexp_extract(body, 'This reverts commit ([0-9a-f]{7,40})', 1) AS cited FROM commits WHERE body IS NOT NULL)
        SELECT DISTINCT k.repo_id, k.sha FROM c JOIN commits k ON k.repo_id = c.repo_id AND starts_with(k.sha, cited)""",
    )
    def _(d):
        return G.reverted_commits(d.commits)

    @q.add("G01_threads", f"WITH RECURSIVE {SQL_THREADS} SELECT session_id, pred, root FROM walk", recursive=True)
    def _(d):
        linked = T.link_sessions(d.sessions, d.patches, d.patch_lines, main_branches(d))
        return linked.select("session_id", "pred", "root")

    @q.add(
        "G01_link_evidence",
        f"""WITH RECURSIVE {SQL_THREADS}, l AS (SELECT w.session_id, w.pred, o.parent FROM walk w JOIN inorder o USING (session_id) WHERE w.pred IS NOT NULL),
        b AS (SELECT l.session_id, arg_min(x.branch, x.branch_no) AS branch FROM l JOIN wb x ON x.session_id = l.session_id JOIN wb y ON y.session_id = l.pred AND y.branch = x.branch GROUP BY 1),
        r AS (SELECT l.session_id, count(*) AS lines FROM l JOIN removed x ON x.session_id = l.session_id JOIN added y ON y.session_id = l.pred AND y.fp = x.fp GROUP BY 1),
        f AS (SELECT l.session_id, count(*) AS shared_files FROM l JOIN files x ON x.session_id = l.session_id JOIN files y ON y.session_id = l.pred AND y.rel_path = x.rel_path GROUP BY 1),
        e AS (SELECT l.*, branch, lines, shared_files, shared_files / (p.n + q.n - shared_files) AS jaccard,
            CASE WHEN parent = pred THEN 'continuation' WHEN branch IS NOT NULL THEN 'same-branch' WHEN lines > 0 THEN 'line-overlap' ELSE 'file-overlap' END AS kind
          FROM l LEFT JOIN b USING (session_id) LEFT JOIN r USING (session_id) LEFT JOIN f USING (session_id)
            LEFT JOIN sizes p ON p.session_id = l.session_id LEFT JOIN sizes q ON q.session_id = l.pred)
        SELECT pred AS from_session_id, session_id AS to_session_id, kind, CASE WHEN kind = 'same-branch' THEN branch END AS branch, CASE WHEN kind = 'line-overlap' THEN lines END AS lines,
          CASE WHEN kind = 'file-overlap' THEN round(jaccard, 2) END AS jaccard, CASE WHEN kind = 'file-overlap' THEN shared_files END AS shared_files FROM e""",
        recursive=True,
    )
    def _(d):
        linked = T.link_sessions(d.sessions, d.patches, d.patch_lines, main_branches(d))
        return T.link_evidence(linked, d.sessions, d.patches, d.patch_lines, main_branches(d))

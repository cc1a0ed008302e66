"""Column functions applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from worklake.bindings import KEY, Domain
from worklake.functions import paths as P
from worklake.functions import redact as R
from worklake.functions import text as X
from worklake.plans.registry import Registry
from worklake.sources.gitlog import added_lines, parse_commits, significant, snapshot_lines

IPAD, OPAD = X.hmac_pads(KEY)


def sql_norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '{X.SPACE}+', ' ', 'g'))"


def sql_hmac(n: str) -> str:
    return (
        f"sha256(unhex('{OPAD}') || unhex(sha256(unhex('{IPAD}') || encode({n}))))"
    )


def sql_fp(n: str) -> str:
    return f"substring({sql_hmac(n)}, 1, 16)"


def sql_significant(n: str) -> str:
    return f"(length({n}) >= 8 AND regexp_matches({n}, '[\\p{{L}}\\p{{N}}]'))"


LINES = f"""
    lines0 AS (SELECT doc_id, unnest(string_split_regex(nfc_normalize(text), '\\r?\\n')) AS line,
        generate_subscripts(string_split_regex(nfc_normalize(text), '\\r?\\n'), 1) - 1 AS pos FROM documents),
    lines1 AS (SELECT doc_id, pos, {sql_norm('line')} AS n FROM lines0)"""


def re2(pattern: str) -> str:
    return pattern.replace(R.B, r"\b").replace(R.E, r"\b").replace("'", "''")


def sql_redact_steps(source: str) -> tuple[str, str]:
    """CTEs that apply the secret rules one by one, and the name of the last one."""
    steps, prev = [], source
    for i, (name, pattern, replacement) in enumerate(R.SECRET_RULES):
        p, r = re2(pattern), replacement.replace("$", "\\")
        steps.append(
            f"r{i} AS (SELECT * EXCLUDE (t), regexp_replace(t, '{p}', '{r}', 'g') AS t, "
            f"len(regexp_extract_all(t, '{p}')) AS n_{name} FROM {prev})"
        )
        prev = f"r{i}"
    return ", ".join(steps), prev


def sql_category(p: str) -> str:
    whens = " ".join(f"WHEN regexp_matches(lower({p}), '{pat}') THEN '{name}'" for name, pat in P.CATEGORY_RULES)
    return f"CASE {whens} ELSE 'Code' END"


URL_PATH = "regexp_replace(regexp_replace(url, '^https?://[^/]*/', ''), '[?#].*$', '')"


def url_path():
    return F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*/", ""), "[?#].*$", "")


def doc_lines(d: Domain):
    return d.documents.select(
        "doc_id", F.posexplode(X.split_lines(X.nfc(F.col("text")))).alias("pos", "line")
    )


def patch_log(d: Domain):
    """Documents as commit records of a patch export; every third touches a second file."""
    k = F.col("doc_id")
    name = F.concat(F.lit("src/f"), (k % 7).cast("string"), F.lit(".txt"))
    body = F.concat(F.lit("+"), F.regexp_replace("text", "\n", "\n+"))
    diff = lambda path, lines: F.concat(
        F.lit("\ndiff --git a/"), path, F.lit(" b/"), path, F.lit("\nindex 1..2\n--- a/"), path, F.lit("\n+++ b/"), path,
        F.lit("\n@@ -0,0 +1,9 @@\n"), lines,
    )
    record = F.concat(
        F.lit("h"), k.cast("string"), F.lit("\u0002"), (k * 3600).cast("string"), F.lit("\u0002subject "), k.cast("string"),
        diff(name, body),
        F.when(k % 3 == 0, diff(F.lit("other.txt"), F.lit("-old\n+++ counter increased\n+plain other line"))).otherwise(""),
    )
    return d.documents.select(F.col("lang").alias("repo_id"), record.alias("record"))


def register(q: Registry) -> None:
    @q.add(
        "S14_commit_patch_lines",
        f"""WITH {LINES}, f AS (SELECT lang AS repo_id, 'src/f' || (doc_id % 7) || '.txt' AS rel_path, 'h' || doc_id AS sha, doc_id * 3600000 AS commit_ms, n FROM lines1 JOIN documents USING (doc_id)
          UNION ALL SELECT lang, 'other.txt', 'h' || doc_id, doc_id * 3600000, unnest(['++ counter increased', 'plain other line']) FROM documents WHERE doc_id % 3 = 0)
        SELECT repo_id, rel_path, sha, commit_ms, {sql_fp('n')} AS fp, count(*) AS n FROM f WHERE {sql_significant('n')} AND rel_path <> 'src/f5.txt' GROUP BY ALL""",
    )
    def _(d):
        commits = parse_commits(patch_log(d))
        touched = commits.select("repo_id").distinct().select(
            "repo_id", F.explode(F.array(F.lit("other.txt"), *[F.lit(f"src/f{i}.txt") for i in (0, 1, 2, 3, 4, 6)])).alias("rel_path")
        )
        return added_lines(commits, touched, KEY).groupBy("repo_id", "rel_path", "sha", "commit_ms", "fp").agg(F.count("*").alias("n"))

    @q.add(
        "S14_commits",
        "SELECT lang AS repo_id, 'h' || doc_id AS sha, doc_id * 3600000 AS commit_ms, 'subject ' || doc_id AS subject FROM documents",
    )
    def _(d):
        return parse_commits(patch_log(d)).drop("patch")

    @q.add(
        "S15_snapshot_lines",
        f"""WITH {LINES} SELECT DISTINCT lang AS repo_id, source AS rel_path, {sql_fp('n')} AS fp FROM lines1 JOIN documents USING (doc_id) WHERE {sql_significant('n')}""",
    )
    def _(d):
        files = d.documents.select(
            F.col("lang").alias("repo_id"), F.col("source").alias("rel_path"), F.lit("worktree").alias("kind"),
            F.col("text").alias("content"),
        )
        return snapshot_lines(files, KEY).drop("kind")

    @q.add("T01_normalize_line", f"WITH {LINES} SELECT doc_id, pos, n FROM lines1")
    def _(d):
        return doc_lines(d).select("doc_id", "pos", X.squeeze(F.col("line")).alias("n"))

    @q.add(
        "T02_significant_lines",
        f"WITH {LINES} SELECT doc_id, count(*) AS lines, count(*) FILTER ({sql_significant('n')}) AS significant FROM lines1 GROUP BY doc_id",
    )
    def _(d):
        n = X.squeeze(F.col("line"))
        return doc_lines(d).groupBy("doc_id").agg(
            F.count("*").alias("lines"), F.count_if(X.is_significant(n)).alias("significant")
        )

    @q.add(
        "T03_line_fingerprint",
        f"WITH {LINES} SELECT {sql_fp('n')} AS fp, count(*) AS n, count(DISTINCT doc_id) AS docs FROM lines1 WHERE {sql_significant('n')} GROUP BY 1",
    )
    def _(d):
        rows = significant(doc_lines(d), F.col("line"))
        rows = rows.select("doc_id", X.line_fingerprint(F.col("norm"), KEY).alias("fp"))
        return rows.groupBy("fp").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))

    @q.add(
        "T04_fingerprint_all",
        f"""WITH {LINES}, firsts AS (SELECT doc_id, n, min(pos) AS pos FROM lines1 WHERE {sql_significant('n')} GROUP BY doc_id, n)
        SELECT doc_id, string_agg({sql_fp('n')}, ',' ORDER BY pos) AS fps FROM firsts GROUP BY doc_id""",
    )
    def _(d):
        fps = X.fingerprint_all(X.split_lines(X.nfc(F.col("text"))), KEY)
        return d.documents.select("doc_id", fps.alias("fps")).where(F.size("fps") > 0)

    @q.add(
        "T05_fingerprint_diff",
        f"""WITH {LINES}, s AS (SELECT DISTINCT doc_id, n FROM lines1 WHERE {sql_significant('n')}),
        pairs AS (SELECT a.doc_id AS new_id, b.doc_id AS old_id FROM documents a JOIN documents b ON b.doc_id = a.doc_id - 1)
        SELECT new_id AS doc_id,
          (SELECT count(*) FROM s WHERE s.doc_id = new_id AND n NOT IN (SELECT n FROM s o WHERE o.doc_id = old_id)) AS added,
          (SELECT count(*) FROM s WHERE s.doc_id = old_id) AS removed FROM pairs""",
    )
    def _(d):
        lines = X.split_lines(X.nfc(F.col("text")))
        old = d.documents.select((F.col("doc_id") + 1).alias("doc_id"), lines.alias("old"))
        new = d.documents.select("doc_id", lines.alias("new"))
        diff = X.fingerprint_diff(F.col("new"), F.col("old"), KEY)
        return new.join(old, "doc_id").select(
            "doc_id", F.size(diff["added"]).alias("added"), F.size(diff["removed"]).alias("removed")
        )

    @q.add(
        "T06_event_fingerprint",
        """SELECT event_id, substring(sha256('{"at":"' || strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') || '"'
          || coalesce(',"command":' || to_json(display), '') || ',"eventType":' || to_json(event_type)
          || coalesce(',"filePath":' || to_json(file_path), '') || ',"provider":"claude-code"'
          || ',"providerEventId":"e' || event_id || '"' || ',"providerEventType":' || to_json(provider_event_type)
          || ',"sequence":' || seq || ',"sessionId":' || to_json(session_id)
          || coalesce(',"toolCallId":' || to_json(call_id), '') || ',"v":1}'), 1, 32) AS fingerprint FROM log_events""",
    )
    def _(d):
        return d.log_events.select(
            "event_id",
            X.event_fingerprint(
                F.col("provider"), F.concat(F.lit("e"), "event_id"), F.col("provider_event_type"),
                F.col("session_id"), F.col("event_type"), F.timestamp_millis("ts_ms"), F.col("seq"),
                F.col("call_id"), F.col("file_path"), F.col("display"),
            ).alias("fingerprint"),
        )

    @q.add(
        "T07_patch_key",
        """WITH p AS (SELECT patch_id, session_id, rel_path, ts_ms,
            list(fp ORDER BY ordinal) FILTER (side = 'added') AS a, list(fp ORDER BY ordinal) FILTER (side = 'removed') AS r
          FROM patch_lines GROUP BY patch_id, session_id, rel_path, ts_ms)
        SELECT patch_id, substring(sha256('{"added":[' || coalesce('"' || array_to_string(a, '","') || '"', '') || '],"at":' || ts_ms
          || ',"operation":"modify","path":' || to_json('/w/' || rel_path) || ',"removed":['
          || coalesce('"' || array_to_string(r, '","') || '"', '') || '],"sessionId":' || to_json(session_id)
          || ',"toolCallId":' || to_json('c' || patch_id) || ',"v":1}'), 1, 32) AS patch_key FROM p""",
    )
    def _(d):
        fps = lambda side: F.transform(
            F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct("ordinal", "fp")))),
            lambda s: s["fp"],
        )
        p = d.patch_lines.groupBy("patch_id", "session_id", "rel_path", "ts_ms").agg(
            fps("added").alias("a"), fps("removed").alias("r")
        )
        return p.select(
            "patch_id",
            X.patch_key(
                F.col("session_id"), F.concat(F.lit("c"), "patch_id"), F.concat(F.lit("/w/"), "rel_path"),
                F.timestamp_millis("ts_ms"), F.lit("modify"), F.col("a"), F.col("r"),
            ).alias("patch_key"),
        )

    steps, last = sql_redact_steps("(SELECT doc_id, text AS t FROM documents)")
    tallies = " + ".join(f"n_{n}" for n, _, _ in R.SECRET_RULES)

    @q.add("T08_redact_secrets", f"WITH {steps} SELECT doc_id, t AS clean, {tallies} AS redactions FROM {last}")
    def _(d):
        return R.redact(d.documents.select("doc_id", "text"), "text", "clean", "redactions").drop("text")

    sums = ", ".join(f"CAST(sum(n_{n}) AS BIGINT) AS {n}" for n, _, _ in R.SECRET_RULES)

    @q.add(
        "T08_redaction_tally",
        f"WITH {sql_redact_steps('(SELECT lang, text AS t FROM documents)')[0]} SELECT lang, {sums} FROM {last} GROUP BY lang",
    )
    def _(d):
        rows = R.redact(d.documents.select("lang", "text"), "text", "clean", "n", by_rule="tally")
        return rows.groupBy("lang").agg(*[F.sum(f"tally.{n}").alias(n) for n, _, _ in R.SECRET_RULES])

    quoted = """"(?:\\\\.|[^"])*"|''(?:\\\\.|[^''])*''"""
    masked = (
        "CASE WHEN s IS NULL THEN '' WHEN len(list_filter(string_split_regex(substring(s, 2, length(s) - 2), "
        f"'{X.SPACE}+'), lambda w: w <> '')) >= 3 OR length(s) - 2 > 48 "
        "THEN substring(s, 1, 1) || '[TEXT]' || substring(s, 1, 1) ELSE s END"
    )
    cmd_steps, cmd_last = sql_redact_steps(
        f"""(SELECT doc_id, string_split_regex(regexp_replace(text, '^{X.SPACE}+|{X.SPACE}+$', '', 'g'), '\\r?\\n')[1] AS t
            FROM (SELECT doc_id, 'run "' || substring(text, 1, doc_id % 90) || '" && ' || text AS text FROM documents))"""
    )

    @q.add(
        "T09_sanitize_command",
        f"""WITH {cmd_steps}, parts AS (SELECT doc_id, {tallies} AS n, string_split_regex(t, '{quoted}') AS pieces,
            regexp_extract_all(t, '{quoted}') AS spans FROM {cmd_last}),
        shown AS (SELECT doc_id, n + len(list_filter(spans, lambda s: {masked} <> s)) AS redactions,
            array_to_string(list_transform(range(len(pieces)), lambda i: pieces[i + 1] || coalesce(list_transform([spans[i + 1]], lambda s: {masked})[1], '')), '') AS t FROM parts)
        SELECT doc_id, redactions, t AS display FROM shown""",
    )
    def _(d):
        cmd = F.concat(
            F.lit('run "'), F.col("text").substr(F.lit(1), (F.col("doc_id") % 90).cast("int")), F.lit('" && '), "text"
        )
        return R.sanitize_command(d.documents.select("doc_id", cmd.alias("c")), "c").select(
            "doc_id", "redactions", "display"
        )

    @q.add(
        "T10_command_executable",
        """SELECT program, count(*) AS n FROM (SELECT 'p' || (o_custkey % 30) AS program FROM orders) GROUP BY program""",
    )
    def _(d):
        k = F.col("o_custkey") % 4
        lead = (
            F.when(k == 0, "cd /tmp && NODE_ENV=x ").when(k == 1, "sudo env A=1 /usr/bin/").when(k == 2, "(").otherwise("time ")
        )
        cmd = F.concat(lead, F.lit("p"), (F.col("o_custkey") % 30).cast("string"), F.lit(" --flag; rm x"))
        return d.orders.select(R.command_executable(cmd).alias("program")).groupBy("program").agg(F.count("*").alias("n"))

    # XOR through arithmetic on long values, one character after the other.
    @q.add(
        "T11_fnv1a_base36",
        """WITH RECURSIVE names AS (SELECT DISTINCT c_name AS name FROM customer),
        f(name, i, h) AS (SELECT name, 0, CAST(2166136261 AS BIGINT) FROM names
          UNION ALL SELECT name, i + 1, (xor(h, CAST(unicode(substring(name, i + 1, 1)) AS BIGINT)) * 16777619) & 4294967295
          FROM f WHERE i < length(name))
        SELECT name, h FROM f WHERE i = length(name)""",
        recursive=True,
    )
    def _(d):
        return d.customer.select(F.col("c_name").alias("name")).distinct().select(
            "name", F.conv(X.base36(X.fnv1a(F.col("name"))), 36, 10).cast("bigint").alias("h")
        )

    @q.add(
        "T12_humanize_branch",
        f"""SELECT branch, coalesce(nullif(trim(regexp_replace(regexp_replace(branch, '{P.BRANCH_PREFIX}', ''), '[/_-]+', ' ', 'g')), ''), branch) AS words,
          count(*) AS n FROM (SELECT coalesce(git_branch_end, git_branch_start) AS branch FROM sessions) WHERE branch IS NOT NULL GROUP BY 1, 2""",
    )
    def _(d):
        b = d.sessions.select(F.coalesce("git_branch_end", "git_branch_start").alias("branch")).where("branch is not null")
        return b.groupBy("branch", P.humanize_branch(F.col("branch")).alias("words")).agg(F.count("*").alias("n"))

    @q.add("T13_path_category", f"SELECT {sql_category('rel_path')} AS category, count(*) AS n FROM patches GROUP BY 1")
    def _(d):
        return d.patches.groupBy(P.path_category(F.col("rel_path")).alias("category")).agg(F.count("*").alias("n"))

    @q.add(
        "T14_top_directory",
        f"""SELECT dir, count(*) AS n FROM (SELECT CASE WHEN len(string_split(p, '/')) > 1
            THEN array_to_string(string_split(p, '/')[1:least(2, len(string_split(p, '/')) - 1)], '/') ELSE p END AS dir
          FROM (SELECT {URL_PATH} AS p FROM pages)) GROUP BY dir""",
    )
    def _(d):
        return d.pages.groupBy(P.top_directory(url_path()).alias("dir")).agg(F.count("*").alias("n"))

    @q.add(
        "T15_relative_path",
        """SELECT page_id, CASE WHEN starts_with(url, root || '/') AND length(url) > length(root) + 1
            THEN substring(url, length(root) + 2) END AS rel, starts_with(url, root || '/en/') AS under_en
          FROM (SELECT page_id, url, regexp_extract(url, '^(https?://[^/]*)', 1) || CASE WHEN page_id % 3 = 0 THEN '/en' ELSE '' END AS root FROM pages)""",
    )
    def _(d):
        root = F.concat(
            F.regexp_extract("url", "^(https?://[^/]*)", 1), F.when(F.col("page_id") % 3 == 0, "/en").otherwise("")
        )
        rows = d.pages.select("page_id", "url", root.alias("root"))
        return rows.select(
            "page_id", P.relative_to(F.col("root"), F.col("url")).alias("rel"),
            (P.under_path(F.col("url"), F.concat("root", F.lit("/en"))) & (F.col("url") != F.concat("root", F.lit("/en")))).alias("under_en"),
        )

    @q.add(
        "T16_ignored_paths",
        """SELECT rel_path, starts_with(rel_path, 'output/') OR starts_with(rel_path, 'src/a/') AS ignored, count(*) AS n FROM patches GROUP BY 1, 2""",
    )
    def _(d):
        raw = F.array(*[F.lit(p) for p in ("./output//", " src/a ", "/abs", "x/../y", "")])
        rows = d.patches.withColumn("prefixes", P.clean_prefixes(raw))
        return rows.groupBy("rel_path", P.is_ignored(F.col("rel_path"), F.col("prefixes")).alias("ignored")).agg(F.count("*").alias("n"))

    @q.add(
        "T17_repo_names",
        """WITH r AS (SELECT c_custkey AS repo_id, '/home/' || lower(c_mktsegment) || '/n' || c_nationkey || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '-' || c_custkey END AS root_path FROM customer),
        b AS (SELECT *, string_split(root_path, '/') AS parts, count(*) OVER (PARTITION BY string_split(root_path, '/')[-1]) AS same FROM r)
        SELECT repo_id, CASE WHEN same > 1 THEN parts[-2] || '/' || parts[-1] ELSE parts[-1] END AS name FROM b""",
    )
    def _(d):
        root = F.concat(
            F.lit("/home/"), F.lower("c_mktsegment"), F.lit("/n"), "c_nationkey",
            F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.concat(F.lit("-"), "c_custkey")),
        )
        repos = d.customer.select(F.col("c_custkey").alias("repo_id"), root.alias("root_path"))
        return P.repo_names(repos).select("repo_id", "name")

    stops = ", ".join(f"'{w}'" for w in X.STOP_WORDS)

    @q.add(
        "T18_query_terms",
        f"""WITH t AS (SELECT item_id, list_filter(list_transform(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_.\\-]+'),
            lambda w: regexp_replace(w, '^[.\\-]+|[.\\-]+$', '', 'g')), lambda w: length(w) >= 3) AS words FROM benchmark),
        u AS (SELECT item_id, CASE WHEN len(list_filter(words, lambda w: w NOT IN ({stops}))) > 0
            THEN list_filter(words, lambda w: w NOT IN ({stops})) ELSE words END AS words FROM t),
        e AS (SELECT item_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM u)
        SELECT item_id, string_agg(w, ',' ORDER BY i) AS terms FROM (SELECT item_id, w, min(i) AS i FROM e GROUP BY item_id, w) GROUP BY item_id""",
    )
    def _(d):
        return d.benchmark.select("item_id", X.query_terms(F.col("text")).alias("terms"))

    home = R.HOME_DIR.replace("'", "''")
    p_steps, p_last = sql_redact_steps(
        "(SELECT conv_id, turn, 'see /home/u' || conv_id || '/x and ' || text AS t FROM conversations)"
    )

    @q.add(
        "T19_privacy_filter",
        f"""WITH {p_steps}, h AS (SELECT conv_id, turn, regexp_replace(t, '{home}', '\\1~', 'g') AS t FROM {p_last})
        SELECT conv_id, turn, t AS shown FROM h""",
    )
    def _(d):
        t = F.concat(F.lit("see /home/u"), "conv_id", F.lit("/x and "), "text")
        return d.conversations.select("conv_id", "turn", R.privacy_filter(t).alias("shown"))

    @q.add(
        "T20_display_names",
        """SELECT session_id, CASE provider WHEN 'codex' THEN 'Codex' ELSE 'Claude Code' END AS agent,
          CASE WHEN n >= 1000000000 THEN printf('%.1fB', n / 1e9 + CASE WHEN n / 1e9 * 4 = floor(n / 1e9 * 4) THEN 0.01 ELSE 0 END) WHEN n >= 1000000 THEN printf('%.1fM', n / 1e6 + CASE WHEN n / 1e6 * 4 = floor(n / 1e6 * 4) THEN 0.01 ELSE 0 END)
            WHEN n >= 1000 THEN CAST(floor(n / 1000.0 + 0.5) AS BIGINT) || 'k' ELSE CAST(n AS VARCHAR) END AS tokens
          FROM (SELECT session_id, provider, coalesce(input_tokens, 0) * (event_count * event_count + 1) AS n FROM sessions)""",
    )
    def _(d):
        n = F.coalesce("input_tokens", F.lit(0)) * (F.col("event_count") * F.col("event_count") + 1)
        return d.sessions.select(
            "session_id", X.agent_name(F.col("provider")).alias("agent"), X.compact_count(n).alias("tokens")
        )

    @q.add(
        "T21_wilson_interval",
        """SELECT repo_id, k, n, round(greatest(0, c - h), 6) AS lo, round(least(1, c + h), 6) AS hi FROM (
          SELECT repo_id, k, n, (k / n + 2.706025 / (2 * n)) / (1 + 2.706025 / n) AS c,
            1.645 * sqrt((k / n) * (1 - k / n) / n + 2.706025 / (4.0 * n * n)) / (1 + 2.706025 / n) AS h
          FROM (SELECT repo_id, count(*) FILTER (class = 'landed') AS k, count(*) AS n FROM outcomes WHERE class <> 'unknown' GROUP BY repo_id))""",
    )
    def _(d):
        g = d.outcomes.where("class <> 'unknown'").groupBy("repo_id").agg(
            F.count_if(F.col("class") == "landed").alias("k"), F.count("*").alias("n")
        )
        w = X.wilson(F.col("k"), F.col("n"))
        return g.select("repo_id", "k", "n", w["lo"].alias("lo"), w["hi"].alias("hi"))

    # Bounds in a zone with daylight saving; whole offsets checked against fixed rules for the zone.
    @q.add(
        "T22_local_day",
        """SELECT o_orderkey AS id, epoch_ms(o_orderdate) - 9 * 3600000 AS from_ms, epoch_ms(o_orderdate) + 15 * 3600000 AS to_ms FROM orders""",
    )
    def _(d):
        day = X.local_day(F.to_date("o_orderdate"), "Asia/Tokyo")
        return d.orders.select(
            F.col("o_orderkey").alias("id"), X.epoch_ms(day["from"]).alias("from_ms"), X.epoch_ms(day["to"]).alias("to_ms")
        )

    @q.add(
        "T23_diff_path",
        f"""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 5 = 1 THEN 'é/' || {URL_PATH} ELSE {URL_PATH} END AS path FROM pages""",
    )
    def _(d):
        k = F.col("page_id") % 5
        header = (
            F.when(k == 0, "/dev/null")
            .when(k == 1, F.concat(F.lit('"b/\\303\\251/'), url_path(), F.lit('"')))
            .when(k == 2, F.concat(F.lit("b/"), url_path(), F.lit("\t")))
            .otherwise(F.concat(F.lit("b/"), url_path()))
        )
        return d.pages.select("page_id", P.diff_path(header).alias("path"))

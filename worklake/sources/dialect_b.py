"""Dialect B rollouts (event log with cumulative counters) to normalized frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklake.config import SECOND
from worklake.functions.redact import sanitize_command
from worklake.functions.text import fingerprint_diff, nfc, split_lines
from worklake.operators.usage import changed_counters, counter_deltas
from worklake.sources import variants as V
from worklake.sources.dialect_a import Logs
from worklake.sources.files import first_lines, sticky

PROVIDER = "codex"
# Line, message and item types without use; the line head layout of the dialect.
SKIPPED_TYPES = (
    "response_item", "compacted", "world_state", "inter_agent_communication_metadata",
    "token_usage_record",
)
IGNORED_MESSAGES = ("task_started", "thread_settings_applied", "thread_goal_updated")
IGNORED_ITEMS = (
    "AgentMessage", "Reasoning", "ImageView", "ContextCompaction", "FunctionCallOutput",
    "Extension", "EnteredReviewMode", "ExitedReviewMode",
)
HEAD_TYPE = r'^\{"timestamp":"[^"]*",(?:"ordinal":\d+,)?"type":"([a-z_]+)"'
FORK_WINDOW_MS = SECOND


def skip_heavy(lines: DataFrame) -> DataFrame:
    """Drops bulky line types by their first characters, before any JSON is parsed."""
    head = F.regexp_extract("value", HEAD_TYPE, 1)
    return lines.where(~head.isin(*SKIPPED_TYPES))


def triage(lines: DataFrame) -> DataFrame:
    doc = F.col("doc")
    parsed = V.pinned(
        skip_heavy(lines).where(F.trim("value") != ""), doc=F.try_parse_json("value")
    )
    parsed = V.pinned(
        parsed,
        is_object=F.ltrim("value").startswith("{"),
        type=F.coalesce(V.text(doc, "$.type"), F.lit("<none>")),
        ts=V.text(doc, "$.timestamp"),
        message=V.text(doc, "$.payload.type"),
        log_ordinal=V.count(doc, "$.ordinal"),
    )
    context = F.col("type") == "turn_context"
    parsed = V.pinned(
        parsed.drop("value"),
        ts_ms=V.instant_ms(F.col("ts")),
        ctx_cwd=F.when(context, V.text(doc, "$.payload.cwd")),
        ctx_model=F.when(context, V.text(doc, "$.payload.model")),
    )
    return V.pinned(
        parsed,
        disposition=F.when(doc.isNull(), "invalid-json")
        .when(~F.col("is_object"), "not-an-object")
        .when(F.col("type").isin(*SKIPPED_TYPES), "ignored")
        .when(F.col("ts").isNull(), "missing-field")
        .when(F.col("ts_ms").isNull(), "invalid-timestamp")
        .when(F.col("type") == "session_meta", "header")
        .when(F.col("type") == "turn_context", "context")
        .when(F.col("type") != "event_msg", "unknown")
        .when(F.col("message").isin(*IGNORED_MESSAGES), "ignored")
        .otherwise("known"),
    )


def headers(triaged: DataFrame, lines: DataFrame) -> DataFrame:
    """The session header of each file: only the very first of its `lines` counts.

    Few lines are headers; they meet one small row per file.
    """
    doc = F.col("doc")
    p = lambda path: V.text(doc, f"$.payload.{path}")
    start = V.count(doc, "$.payload.subagent_history_start_ordinal")
    own_ms = F.coalesce(V.instant_ms(p("timestamp")), F.col("ts_ms"))
    return triaged.where("disposition = 'header'").join(first_lines(lines), ["file", "ordinal"]).select(
        "file",
        F.coalesce(F.col("session_from_name"), p("id")).alias("session_id"),
        F.coalesce(p("parent_thread_id"), p("source.subagent.thread_spawn.parent_thread_id")).alias(
            "parent_session_id"
        ),
        p("cli_version").alias("provider_version"),
        p("cwd").alias("head_cwd"),
        p("git.branch").alias("git_branch"),
        p("git.commit_hash").alias("git_head"),
        F.col("ts_ms").alias("head_line_ms"),
        own_ms.alias("head_ms"),
        F.when(p("forked_from_id").isNotNull() & (start > 1), start).alias("fork_start"),
    )


#: What tells where a line belongs; rows that carry these can be placed without their documents.
PLACE = ["file", "session_from_name", "ordinal", "ts_ms", "type", "disposition", "log_ordinal", "ctx_cwd", "ctx_model"]


def own_lines(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows of the file's own session: copied parent history at a fork's top is removed.

    One small header row per file joins back by file.
    """
    rows = rows.where(F.col("disposition").isin("context", "known", "unknown"))
    joined = rows.join(heads, "file", "left")
    copied = (
        F.col("fork_start").isNotNull()
        & (F.col("log_ordinal") > 0)
        & (F.col("log_ordinal") < F.col("fork_start"))
        & (F.abs(F.col("ts_ms") - F.col("head_ms")) <= FORK_WINDOW_MS)
    )
    return joined.where(~F.coalesce(copied, F.lit(False))).withColumn(
        "session_id", F.coalesce("session_id", "session_from_name")
    )


def with_context(rows: DataFrame) -> DataFrame:
    """Adds cwd and model as set by the nearest turn context at or before each row.

    Before the first context of these rows holds what the log's header row carries: what earlier
    chunks have set, then the header's own folder.
    """
    filled = sticky(rows, {"near_cwd": F.col("ctx_cwd"), "near_model": F.col("ctx_model")})
    carried = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    return (
        filled.withColumn("cwd", F.coalesce("near_cwd", carried("carried_cwd"), "head_cwd"))
        .withColumn("model", F.coalesce("near_model", carried("carried_model")))
        .drop("near_cwd", "near_model", "carried_cwd", "carried_model", "ctx_cwd", "ctx_model")
    )


def _placed(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Own rows with session, cwd and model. Context lines are among them; documents are not."""
    return with_context(own_lines(rows, heads))


def command_text(item: Column) -> Column:
    """`[sh, -lc, cmd]` is cmd; other argument lists are joined; a plain string stays."""
    argv = F.try_variant_get(item, "$.command", "array<string>")
    shell = F.element_at(F.split(F.get(argv, F.lit(0)), "/"), -1).rlike("^(ba|z|fi|da)?sh$")
    wrapped = (F.size(argv) >= 3) & shell & F.get(argv, F.lit(1)).rlike(r"^-[A-Za-z0-9_]*c$")
    joined = F.when(wrapped, F.get(argv, F.lit(2))).otherwise(F.array_join(argv, " "))
    return F.nullif(F.coalesce(V.any_text(item, "$.command"), joined), F.lit(""))


def _absolute(path: Column, cwd: Column) -> Column:
    return F.when(path.startswith("/"), path).otherwise(
        F.concat(F.regexp_replace(cwd, "/$", ""), F.lit("/"), path)
    )


def _change_fields(triaged: DataFrame, key: bytes) -> DataFrame:
    """One row per path of completed file-change items, with operation and fingerprints; and context lines."""
    doc = F.col("doc")
    item = V.node(doc, "$.payload.item")
    completed = (
        (F.col("disposition") == "known")
        & (F.col("message") == "item_completed")
        & (V.text(doc, "$.payload.item.type") == "FileChange")
        & (V.text(doc, "$.payload.item.status") == "completed")
    )
    rows = triaged.where((F.col("disposition") == "context") | F.coalesce(completed, F.lit(False)))
    changes = F.map_entries(F.try_variant_get(item, "$.changes", "map<string,variant>"))
    rows = rows.select(*PLACE, V.text(item, "$.id").alias("item_id"), F.posexplode_outer(changes).alias("change_no", "entry"))
    rows = V.pinned(rows, change=F.col("entry.value"), raw_path=F.col("entry.key")).drop("entry")
    change = F.col("change")
    rows = V.pinned(rows, change_kind=V.text(change, "$.type"), moved=V.text(change, "$.move_path"))
    kind, moved = F.col("change_kind"), F.col("moved")
    diff = split_lines(F.coalesce(V.text(change, "$.unified_diff"), F.lit("")))
    body = split_lines(
        F.coalesce(V.text(change, "$.content"), V.text(change, "$.unified_diff"), F.lit(""))
    )
    whole = F.when(F.element_at(body, -1) == "", F.slice(body, F.lit(1), F.size(body) - 1)).otherwise(body)
    side = lambda mark: F.transform(
        F.filter(diff, lambda l: l.startswith(mark) & ~l.startswith("@@")),
        lambda l: l.substr(F.lit(2), F.length(l)),
    )
    none = F.array().cast("array<string>")
    rows = V.pinned(
        rows,
        operation=F.when(kind == "add", "create")
        .when((kind == "update") & moved.isNotNull(), "rename")
        .when(kind == "update", "modify")
        .when(kind == "delete", "delete"),
        __added=F.when(kind == "add", whole).when(kind == "update", side("+")).otherwise(none),
        __removed=F.when(kind == "update", side("-")).otherwise(none),
    ).where("disposition = 'context' or operation is not null")
    composed = lambda c: F.split(nfc(F.array_join(c, "\n")), "\n")
    rows = V.pinned(
        rows.drop("change", "change_kind"),
        added_raw=F.size("__added"),
        removed_raw=F.size("__removed"),
        __added=composed("__added"),
        __removed=composed("__removed"),
    )
    rows = V.pinned(rows, fps=fingerprint_diff(F.col("__added"), F.col("__removed"), key))
    return rows.select(
        "*", F.col("fps.added").alias("added_fps"), F.col("fps.removed").alias("removed_fps")
    ).drop("__added", "__removed", "fps")


def file_changes(triaged: DataFrame, heads: DataFrame, key: bytes) -> DataFrame:
    """One row per changed path of completed file-change items of own lines, paths made absolute."""
    rows = _placed(_change_fields(triaged, key), heads).where("operation is not null")
    original = _absolute(F.col("raw_path"), F.col("cwd"))
    moved = F.coalesce(_absolute(F.col("moved"), F.col("cwd")), original)
    path = F.when(F.col("moved").isNull(), original).otherwise(moved)
    return rows.where(original.isNotNull()).withColumn("path", path).drop("raw_path", "moved")


def _event_fields(triaged: DataFrame) -> DataFrame:
    """Fields of all messages that stand for one event, file changes of completed items excepted; and context lines."""
    doc, item = F.col("doc"), F.col("item")
    rows = triaged.where("disposition in ('known', 'unknown', 'context')").where(
        "disposition <> 'known' or not (message <=> 'token_count')"
    )
    is_item = (F.col("disposition") == "known") & (F.col("message") == "item_completed")
    rows = V.pinned(rows, item=F.when(is_item, V.node(doc, "$.payload.item")))
    error = V.node(doc, "$.payload.error")
    rows = V.pinned(
        rows,
        item_kind=F.when(is_item, F.coalesce(V.text(item, "$.type"), F.lit("<none>"))),
        item_status=V.text(item, "$.status"),
        item_id=V.text(item, "$.id"),
        item_tool=V.text(item, "$.tool"),
        activity=V.text(item, "$.kind"),
        exit_code=F.try_variant_get(item, "$.exit_code", "long"),
        failed_call=F.coalesce(~F.try_variant_get(item, "$.success", "boolean"), F.lit(False)),
        turn_error=error.isNotNull() & (F.schema_of_variant(error) != "VOID"),
    )
    k, status, activity = F.col("item_kind"), F.col("item_status"), F.col("activity")
    rows = rows.where(
        k.isNull()
        | (
            ~k.isin(*IGNORED_ITEMS)
            & ~((k == "FileChange") & F.coalesce(status == "completed", F.lit(False)))
            & ~(
                (k == "SubAgentActivity")
                & ~F.coalesce(activity.isin("started", "completed", "interrupted"), F.lit(False))
            )
        )
    )
    rows = sanitize_command(
        rows.withColumn("command", F.when(k == "CommandExecution", command_text(item))), "command"
    )
    failed = F.coalesce(status == "failed", F.lit(False)) | (
        (k == "CommandExecution") & F.coalesce(F.col("exit_code") != 0, F.lit(False))
    ) | (k.isin("DynamicToolCall", "CollabAgentToolCall") & F.col("failed_call"))
    rows = V.pinned(rows, failed=failed)
    failed, turn_error = F.col("failed"), F.col("turn_error")
    m = F.col("message")
    known = F.col("disposition") == "known"
    context = F.col("disposition") == "context"
    done = lambda family: F.when(failed, f"{family}.failed").otherwise(f"{family}.completed")
    event_type = (
        F.when(context, F.lit(None).cast("string"))
        .when(~known, "unknown")
        .when((m == "task_complete") & turn_error, "error")
        .when(m == "task_complete", "turn.completed")
        .when(m == "turn_aborted", "agent.interrupted")
        .when(k == "UserMessage", "prompt.submitted")
        .when(k == "CommandExecution", done("command"))
        .when((k == "FileChange") & (status == "declined"), "approval.resolved")
        .when(k == "FileChange", "tool.failed")
        .when(k.isin("McpToolCall", "DynamicToolCall", "CollabAgentToolCall"), done("tool"))
        .when(k == "WebSearch", "tool.completed")
        .when((k == "SubAgentActivity") & (activity == "started"), "subagent.started")
        .when(k == "SubAgentActivity", "subagent.ended")
        .otherwise("unknown")
    )
    outcome = (
        F.when((m == "task_complete") & turn_error, "failure")
        .when((k == "FileChange") & (status == "declined"), "denied")
        .when(k == "FileChange", "failure")
        .when(k == "WebSearch", "success")
        .when((k == "SubAgentActivity") & (activity == "completed"), "success")
        .when((k == "SubAgentActivity") & (activity == "interrupted"), "failure")
        .when(
            k.isin("CommandExecution", "McpToolCall", "DynamicToolCall", "CollabAgentToolCall"),
            F.when(failed, "failure").otherwise("success"),
        )
    )
    tool = (
        F.when(k == "CommandExecution", "exec")
        .when(k == "FileChange", "apply_patch")
        .when(
            k == "McpToolCall",
            F.concat_ws(
                "__",
                F.lit("mcp"),
                F.coalesce(V.text(item, "$.server"), F.lit("unknown")),
                F.coalesce("item_tool", F.lit("unknown")),
            ),
        )
        .when(k == "WebSearch", "web_search")
        .when(k.isin("DynamicToolCall", "CollabAgentToolCall"), F.coalesce(F.col("item_tool"), k))
        .when(k == "SubAgentActivity", "subagent")
    )
    category = (
        F.when(k == "CommandExecution", "shell")
        .when(k == "FileChange", "file")
        .when(k == "McpToolCall", "mcp")
        .when(k == "WebSearch", "network")
        .when(F.col("item_kind").isin("DynamicToolCall", "CollabAgentToolCall", "SubAgentActivity"), "other")
    )
    rows = V.pinned(rows, event_type=event_type, status=outcome, tool_name=tool)
    event_type, outcome, tool = F.col("event_type"), F.col("status"), F.col("tool_name")
    vendor_type = (
        F.when(~known, F.col("type"))
        .when(k.isNotNull() & (event_type == "unknown"), F.concat(F.lit("item:"), k))
        .when(event_type == "unknown", F.concat(F.lit("event_msg:"), F.coalesce(m, F.lit("<none>"))))
        .otherwise(F.col("type"))
    )
    vendor_id = F.when(k.isNotNull(), F.col("item_id")).when(
        m.isin("task_complete", "turn_aborted"), V.text(doc, "$.payload.turn_id")
    )
    has_call = k.isNotNull() & tool.isNotNull() & (k != "SubAgentActivity")
    return rows.select(
        *PLACE,
        vendor_type.alias("provider_event_type"),
        vendor_id.alias("provider_event_id"),
        event_type.alias("event_type"),
        outcome.alias("status"),
        F.when(k == "CommandExecution", V.text(item, "$.cwd")).alias("own_cwd"),
        tool.alias("tool_name"),
        category.alias("tool_category"),
        F.when(has_call, F.col("item_id")).alias("call_id"),
        "executable",
        "display",
        "redactions",
    )


def _simple_events(triaged: DataFrame, heads: DataFrame) -> DataFrame:
    """Events of own lines that stand for one each."""
    rows = _placed(_event_fields(triaged), heads).where("event_type is not null and session_id is not null")
    return rows.select(
        "provider_event_type", "session_id", "parent_session_id", "provider_event_id", "provider_version", "ts_ms",
        "event_type", "status", F.coalesce("own_cwd", "cwd").alias("cwd"), _null("git_branch"), "model",
        "tool_name", "tool_category", "call_id", "executable", "display", "redactions", _null("file_path"),
        _null("file_operation"), F.when(F.col("event_type") == "error", "turn-error").alias("error_code"),
        "file", "ordinal", F.lit(0).alias("seq"),
    )


def _null(name: str, kind: str = "string") -> Column:
    return F.lit(None).cast(kind).alias(name)


def _edit_events(changes: DataFrame) -> DataFrame:
    call = F.col("item_id")
    return changes.select(
        F.col("type").alias("provider_event_type"), "session_id", "parent_session_id",
        call.alias("provider_event_id"), "provider_version", "ts_ms",
        F.lit("edit.applied").alias("event_type"), F.lit("success").alias("status"),
        "cwd", _null("git_branch"), "model",
        F.lit("apply_patch").alias("tool_name"), F.lit("file").alias("tool_category"),
        call.alias("call_id"), _null("executable"), _null("display"), F.lit(0).alias("redactions"),
        F.col("path").alias("file_path"), F.col("operation").alias("file_operation"),
        _null("error_code"), "file", "ordinal", F.col("change_no").alias("seq"),
    )


def _start_events(heads: DataFrame) -> DataFrame:
    return heads.where("session_id is not null").select(
        F.lit("session_meta").alias("provider_event_type"), "session_id", "parent_session_id",
        F.col("session_id").alias("provider_event_id"), "provider_version",
        F.col("head_line_ms").alias("ts_ms"), F.lit("session.started").alias("event_type"),
        _null("status"), F.col("head_cwd").alias("cwd"), "git_branch", _null("model"),
        _null("tool_name"), _null("tool_category"), _null("call_id"), _null("executable"),
        _null("display"), F.lit(0).alias("redactions"), _null("file_path"),
        _null("file_operation"), _null("error_code"), "file", F.lit(0).cast("long").alias("ordinal"),
        F.lit(0).alias("seq"),
    )


#: Names of the counters' parts, here and in the reports.
COUNTERS = {
    "input": "input_tokens", "cached": "cached_input_tokens", "output": "output_tokens",
    "reasoning": "reasoning_output_tokens",
}


def _counter_fields(triaged: DataFrame) -> DataFrame:
    """Cumulative and last-call counters of token reports; and context lines."""
    doc = F.col("doc")
    total = lambda n: V.count(doc, f"$.payload.info.total_token_usage.{n}")
    last = lambda n: V.count(doc, f"$.payload.info.last_token_usage.{n}")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    report = (F.col("disposition") == "known") & (F.col("message") == "token_count")
    return triaged.where((F.col("disposition") == "context") | report).select(
        *PLACE,
        F.when(report, total("total_tokens")).alias("total"),
        *[zero(total(v)).alias(k) for k, v in COUNTERS.items()],
        *[zero(last(v)).alias(f"last_{k}") for k, v in COUNTERS.items()],
    )


def token_counters(triaged: DataFrame, heads: DataFrame) -> DataFrame:
    """Counters of each token report of own lines."""
    parts = [*COUNTERS, *[f"last_{k}" for k in COUNTERS]]
    return _placed(_counter_fields(triaged), heads).where("total is not null and session_id is not null").select(
        "file", "session_id", "ordinal", "ts_ms", "model", "total", *parts
    )


def session_facts(triaged: DataFrame, heads: DataFrame) -> DataFrame:
    place = F.struct("ordinal")
    lines = _placed(triaged.select(*PLACE), heads)
    spans = lines.where("session_id is not null").groupBy("file", "session_id").agg(
        F.min("ts_ms").alias("first_ms"),
        F.max("ts_ms").alias("last_ms"),
        F.min_by("cwd", F.when(F.col("cwd").isNotNull(), place)).alias("line_cwd"),
        F.max_by("model", F.when(F.col("model").isNotNull(), place)).alias("model"),
    )
    joined = heads.where("session_id is not null").join(spans, ["file", "session_id"], "full_outer")
    return joined.select(
        "session_id",
        "parent_session_id",
        F.least("head_ms", "first_ms").alias("first_ms"),
        F.greatest("head_ms", "last_ms").alias("last_ms"),
        F.coalesce("head_cwd", "line_cwd").alias("cwd"),
        F.col("git_branch").alias("branch_first"),
        F.col("git_branch").alias("branch_last"),
        "model",
        "provider_version",
        "file",
    )


def thread_names(lines: DataFrame) -> DataFrame:
    """Titles from the thread-name index: the last line of each session wins."""
    doc = F.try_parse_json("value")
    rows = lines.select(
        V.text(doc, "$.id").alias("session_id"),
        V.text(doc, "$.thread_name").alias("title"),
        "file",
        "ordinal",
    ).where("session_id is not null and title is not null")
    return rows.groupBy("session_id").agg(
        F.max_by("title", F.struct("file", "ordinal")).alias("title"),
        F.lit("generated").alias("title_provenance"),
    )


#: What a log carries from one chunk to the next: place, header, context and counter.
STATE = (
    "file string, next_ordinal long, session_id string, parent_session_id string, provider_version string, "
    "head_cwd string, git_branch string, git_head string, head_line_ms long, head_ms long, fork_start long, "
    "carried_cwd string, carried_model string, total long, input long, cached long, output long, reasoning long"
)
_HEAD = [
    "session_id", "parent_session_id", "provider_version", "head_cwd", "git_branch", "git_head", "head_line_ms",
    "head_ms", "fork_start",
]


def log_heads(triaged: DataFrame, lines: DataFrame, state: DataFrame | None) -> DataFrame:
    """Headers of all logs; those that these lines bring are `fresh`. A log that began before brings none."""
    fresh = headers(triaged, lines).withColumn("fresh", F.lit(True))
    if state is None:
        return fresh
    fresh = fresh.join(state.select("file"), "file", "left_anti")
    carried = ["carried_cwd", "carried_model"]
    known = state.select("file", *_HEAD, *carried, F.lit(False).alias("fresh"))
    return fresh.select("*", *[_null(c) for c in carried]).unionByName(known)


def counter_lines(triaged: DataFrame, heads: DataFrame) -> DataFrame:
    """Token reports and context lines of own lines, as fields."""
    return own_lines(_counter_fields(triaged), heads.drop("fresh"))


def carry(own: DataFrame, lines: DataFrame, heads: DataFrame, state: DataFrame) -> DataFrame:
    """State after `lines`, of which `own` are the `counter_lines`: one row a log, whether it has lines here or not."""
    latest = lambda value, known: F.max_by(value, F.when(known, F.col("ordinal")))
    news = own.groupBy("file").agg(
        latest("ctx_cwd", F.col("ctx_cwd").isNotNull()).alias("new_cwd"),
        latest("ctx_model", F.col("ctx_model").isNotNull()).alias("new_model"),
    )
    numbers = ["total", *COUNTERS]
    # A total that is repeated may come with other parts; the next line is compared with the line that brought it.
    reports = own.where("total is not null and session_id is not null").select("file", "ordinal", *numbers)
    counted = changed_counters(reports, before=_last_counters(state)).groupBy("file").agg(
        F.max_by(F.struct(*numbers), "ordinal").alias("counter")
    )
    seen = lines.groupBy("file").agg((F.max("ordinal") + 1).alias("next_ordinal"))
    kept = state.select("file", "carried_cwd", "carried_model")
    return (
        state.select("file", F.col("next_ordinal").alias("old_next")).join(seen, "file", "full_outer")
        .join(heads.select("file", *_HEAD), "file", "left").join(kept, "file", "left")
        .join(news, "file", "left").join(counted, "file", "left")
        .select(
            "file", F.coalesce("next_ordinal", "old_next").alias("next_ordinal"), *_HEAD,
            F.coalesce("new_cwd", "carried_cwd").alias("carried_cwd"), F.coalesce("new_model", "carried_model").alias("carried_model"),
            *[f"counter.{c}" for c in numbers],
        )
    )


def _last_counters(state: DataFrame) -> DataFrame:
    return state.where("total is not null").select("file", "total", *COUNTERS)


def read(lines: DataFrame, key: bytes, state: DataFrame | None = None) -> Logs:
    """`lines` carry file, ordinal, value and session_from_name (null when the name has none).

    With `state` (see `carry`), lines go on where earlier chunks of their logs ended.
    """
    triaged = triage(lines)
    return read_triaged(triaged, log_heads(triaged, lines, state), key, state)


def read_triaged(triaged: DataFrame, heads: DataFrame, key: bytes, state: DataFrame | None = None) -> Logs:
    """`read` for lines that are triaged already, with the headers of their logs."""
    fresh, heads = heads.where("fresh").drop("fresh"), heads.drop("fresh")
    changes = file_changes(triaged, heads, key)
    events = (
        _simple_events(triaged, heads)
        .unionByName(_edit_events(changes.where("session_id is not null")))
        .unionByName(_start_events(fresh))
        .withColumn("provider", F.lit(PROVIDER))
    )
    patches = changes.where(
        "session_id is not null and (added_raw > 0 or removed_raw > 0)"
    ).select(
        F.lit(PROVIDER).alias("provider"), "session_id", F.col("item_id").alias("call_id"), "ts_ms", "path", "operation",
        "added_fps", "removed_fps", "added_raw", "removed_raw", "file", "ordinal",
        F.col("change_no").alias("pos"),
    )
    lost = own_lines(triaged.select(*PLACE), heads).where("session_id is null")
    failures = (
        triaged.where(
            F.col("disposition").isin(
                "invalid-json", "not-an-object", "missing-field", "invalid-timestamp"
            )
        )
        .select("file", "ordinal", F.col("disposition").alias("reason"))
        .unionByName(lost.select("file", "ordinal", F.lit("missing-field").alias("reason")))
    )
    unknown = (
        events.where("event_type = 'unknown'")
        .groupBy(F.col("provider_event_type").alias("type"))
        .agg(F.count("*").alias("n"))
    )
    before = None if state is None else _last_counters(state)
    usage = counter_deltas(token_counters(triaged, heads), before=before).withColumn("provider", F.lit(PROVIDER))
    return Logs(events, patches, usage, session_facts(triaged, heads), failures, unknown)

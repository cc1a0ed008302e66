"""Dialect A transcripts (one JSON object per line) to normalized frames.

Input lines carry file, ordinal and value. Prompt and answer texts are read, never emitted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklake.functions.redact import sanitize_command
from worklake.functions.text import fingerprint_diff, nfc, split_lines
from worklake.sources import variants as V

PROVIDER = "claude-code"
# Line types without use, the interruption marker and tool families of the dialect.
IGNORED_TYPES = (
    "attachment", "queue-operation", "mode", "permission-mode", "file-history-snapshot",
    "file-history-delta", "bridge-session", "frame-link", "atis-latch",
    "artifact-autoreact-ledger", "artifact-comment-monitor", "agent-name", "last-prompt", "summary",
    "pr-link", "continued-in",
)
INTERRUPT_MARKER = "[Request interrupted by user"
SHELL_TOOLS = ("Bash", "BashOutput", "KillShell")
FILE_TOOLS = ("Read", "Edit", "Write", "MultiEdit", "NotebookEdit")
SEARCH_TOOLS = ("Grep", "Glob", "LS", "ToolSearch")
NETWORK_TOOLS = ("WebFetch", "WebSearch")
SUBAGENT_TOOLS = ("Agent", "Task")
ASK_USER_TOOLS = ("AskUserQuestion",)
SYNTHETIC = "<synthetic>"
CONVERSATION_TYPES = ("user", "assistant", "system")


@dataclass
class Logs:
    """Normalized frames of one dialect."""

    events: DataFrame
    patches: DataFrame
    usage: DataFrame
    sessions: DataFrame
    failures: DataFrame
    unknown_types: DataFrame


def tool_category(name: Column) -> Column:
    return (
        F.when(name.isin(*SHELL_TOOLS), "shell")
        .when(name.isin(*FILE_TOOLS), "file")
        .when(name.isin(*SEARCH_TOOLS), "search")
        .when(name.isin(*NETWORK_TOOLS), "network")
        .when(name.startswith("mcp__"), "mcp")
        .otherwise("other")
    )


def triage(lines: DataFrame) -> DataFrame:
    """Adds the parsed document, its type and what to do with the line."""
    doc = F.col("doc")
    parsed = V.pinned(lines.where(F.trim("value") != ""), doc=F.try_parse_json("value"))
    parsed = V.pinned(
        parsed,
        is_object=F.ltrim("value").startswith("{"),
        type=F.coalesce(V.text(doc, "$.type"), F.lit("<none>")),
        vendor_session=V.text(doc, "$.sessionId"),
        ts=V.text(doc, "$.timestamp"),
    )
    parsed = V.pinned(parsed.drop("value"), ts_ms=V.instant_ms(F.col("ts")))
    no_identity = F.col("vendor_session").isNull() | F.col("ts").isNull()
    known = F.col("type").isin(*CONVERSATION_TYPES)
    return V.pinned(
        parsed,
        disposition=F.when(doc.isNull(), "invalid-json")
        .when(~F.col("is_object"), "not-an-object")
        .when(F.col("type").isin("custom-title", "ai-title"), "title")
        .when(F.col("type") == "cost-state", "cost")
        .when(F.col("type").isin(*IGNORED_TYPES), "ignored")
        .when(no_identity & known, "missing-field")
        .when(no_identity, "unknown-type")
        .when(F.col("ts_ms").isNull(), "invalid-timestamp")
        .when(known, "known")
        .otherwise("unknown"),
    )


def identify(triaged: DataFrame) -> DataFrame:
    """Event lines with their session: side-chain lines belong to `session:agent`."""
    doc = F.col("doc")
    rows = V.pinned(
        triaged.where(F.col("disposition").isin("known", "unknown")),
        agent_id=F.when(V.flag(doc, "$.isSidechain"), V.text(doc, "$.agentId")),
        cwd=V.text(doc, "$.cwd"),
        git_branch=V.text(doc, "$.gitBranch"),
        version=V.text(doc, "$.version"),
        message_model=V.text(doc, "$.message.model"),
        message_key=F.coalesce(V.text(doc, "$.message.id"), V.text(doc, "$.requestId")),
    )
    sub = F.col("agent_id").isNotNull()
    return V.pinned(
        rows,
        session_id=F.when(sub, F.concat_ws(":", "vendor_session", "agent_id")).otherwise(
            F.col("vendor_session")
        ),
        parent_session_id=F.when(sub, F.col("vendor_session")),
        model=F.when(
            (F.col("type") == "assistant") & (F.col("message_model") != SYNTHETIC),
            F.col("message_model"),
        ),
    )


def _line_items(doc: Column) -> Column:
    """What one line stands for: array of struct(kind, block)."""
    none = F.lit(None).cast("variant")
    single = lambda kind: F.array(F.struct(F.lit(kind).alias("kind"), none.alias("block")))
    empty = F.array().cast("array<struct<kind:string,block:variant>>")
    content = V.items(doc, "$.message.content")
    of_type = lambda t: F.filter(content, lambda b: F.coalesce(V.text(b, "$.type") == t, F.lit(False)))
    tagged = lambda kind, blocks: F.transform(
        blocks, lambda b: F.struct(F.lit(kind).alias("kind"), b.alias("block"))
    )
    ended = (V.text(doc, "$.message.stop_reason") == "end_turn") & F.col("message_key").isNotNull()
    assistant = F.when(V.flag(doc, "$.isApiErrorMessage"), single("api-error")).otherwise(
        F.concat(
            tagged("call", of_type("tool_use")),
            F.when(F.coalesce(ended, F.lit(False)), single("turn")).otherwise(empty),
        )
    )
    plain = V.any_text(doc, "$.message.content")
    interrupted = F.coalesce(plain.startswith(INTERRUPT_MARKER), F.lit(False)) | F.exists(
        of_type("text"),
        lambda b: F.coalesce(V.any_text(b, "$.text").startswith(INTERRUPT_MARKER), F.lit(False)),
    )
    results = of_type("tool_result")
    user = (
        F.when(V.flag(doc, "$.isMeta") | V.flag(doc, "$.isCompactSummary"), empty)
        .when(V.flag(doc, "$.interruptedByShutdown"), single("interrupted"))
        .when(F.size(results) > 0, tagged("result", results))
        .when(interrupted, single("interrupted"))
        .otherwise(single("prompt"))
    )
    system = F.when(V.text(doc, "$.subtype") == "api_error", single("system-error")).otherwise(empty)
    return (
        F.when(F.col("type") == "assistant", assistant)
        .when(F.col("type") == "user", user)
        .when(F.col("type") == "system", system)
        .otherwise(single("unknown"))
    )


def _result_text(block: Column) -> Column:
    first = F.get(
        F.filter(
            V.items(block, "$.content"),
            lambda c: F.coalesce(V.text(c, "$.type") == "text", F.lit(False)),
        ),
        F.lit(0),
    )
    return F.coalesce(V.any_text(block, "$.content"), V.any_text(first, "$.text"), F.lit(""))


def line_items(identified: DataFrame) -> DataFrame:
    """One row per item with its tool described, results paired with the call they answer.

    Calls and results meet in one window on (file, call): one shuffle, no self-join. Items without
    a call id get a key of their own, so they spread evenly.
    """
    block = F.col("block")
    is_call = F.col("kind") == "call"
    rows = identified.select("*", F.posexplode(_line_items(F.col("doc"))).alias("pos", "item"))
    rows = V.pinned(rows, kind=F.col("item.kind"), block=F.col("item.block")).drop("item")
    rows = V.pinned(
        rows,
        call_id=F.when(is_call, V.text(block, "$.id")).otherwise(V.text(block, "$.tool_use_id")),
        name=F.when(is_call, F.coalesce(V.text(block, "$.name"), F.lit("unknown"))),
        path=F.when(
            is_call,
            F.coalesce(V.text(block, "$.input.file_path"), V.text(block, "$.input.notebook_path")),
        ),
    )
    rows = V.pinned(rows, category=F.when(is_call, tool_category(F.col("name"))))
    rows = V.pinned(
        rows,
        command=F.when(F.col("category") == "shell", V.text(block, "$.input.command")),
        path=F.when((F.col("category") != "shell") & F.col("path").startswith("/"), F.col("path")),
    )
    rows = sanitize_command(rows, "command").withColumn(
        "told",
        F.when(is_call, F.struct("name", "category", "executable", "display", "redactions", "path")),
    )
    call = F.coalesce(
        F.concat(F.lit("c"), F.col("call_id")), F.concat_ws("-", F.lit("n"), "ordinal", "pos")
    )
    seen = (
        Window.partitionBy("file", "__call")
        .orderBy("ordinal", "pos")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    outcome = V.node(F.col("doc"), "$.toolUseResult")
    has = lambda p: V.node(outcome, p).isNotNull()
    result_path = V.any_text(outcome, "$.filePath")
    guessed = F.struct(
        F.lit("unknown").alias("name"),
        F.when(has("$.stdout") | has("$.stderr"), "shell")
        .when(result_path.isNotNull(), "file")
        .otherwise("other")
        .alias("category"),
        F.lit(None).cast("string").alias("executable"),
        F.lit(None).cast("string").alias("display"),
        F.lit(0).alias("redactions"),
        F.when(~(has("$.stdout") | has("$.stderr")), result_path).alias("path"),
    )
    paired = V.pinned(rows, __call=call).withColumn(
        "tool", F.last("told", ignorenulls=True).over(seen)
    )
    keep = [c for c in identified.columns] + ["pos", "kind", "block", "call_id"]
    return paired.select(
        *keep,
        F.when(F.col("kind").isin("call", "result"), F.coalesce("tool", guessed)).alias("tool"),
    )


def with_patches(items: DataFrame, key: bytes) -> DataFrame:
    """Adds the patch of successful results: path, operation, fingerprints and raw line counts."""
    out = V.node(F.col("doc"), "$.toolUseResult")
    hunks = V.items(out, "$.structuredPatch")
    is_patch = V.node(out, "$.structuredPatch").isNotNull() & F.schema_of_variant(
        V.node(out, "$.structuredPatch")
    ).startswith("ARRAY")
    lines = F.flatten(
        F.transform(
            hunks,
            lambda h: F.coalesce(
                F.try_variant_get(h, "$.lines", "array<string>"), F.array().cast("array<string>")
            ),
        )
    )
    side = lambda mark: F.transform(
        F.filter("__lines", lambda l: l.startswith(mark)),
        lambda l: l.substr(F.lit(2), F.length(l)),
    )
    created = V.text(out, "$.type") == "create"
    body = split_lines(V.any_text(out, "$.content"))
    body = F.when(F.element_at(body, -1) == "", F.slice(body, F.lit(1), F.size(body) - 1)).otherwise(body)
    ok = (
        (F.col("kind") == "result")
        & ~F.col("failed")
        & ~F.col("denied")
        & ~F.col("interrupted_result")
        & V.text(out, "$.filePath").startswith("/")
        & is_patch
    )
    rows = V.pinned(items, __ok=F.coalesce(ok, F.lit(False)))
    rows = V.pinned(rows, __lines=F.when(F.col("__ok"), lines))
    rows = V.pinned(rows, __hunk_added=side("+"), __removed=side("-"))
    from_body = F.col("__ok") & created & (F.size("__hunk_added") == 0) & body.isNotNull()
    rows = V.pinned(
        rows, __added=F.when(F.coalesce(from_body, F.lit(False)), body).otherwise(F.col("__hunk_added"))
    )
    # Compose whole sides at once: one string per side crosses to Python only when it needs to.
    composed = lambda c: F.split(nfc(F.array_join(c, "\n")), "\n")
    has_lines = F.col("__ok") & ((F.size("__added") > 0) | (F.size("__removed") > 0))
    rows = V.pinned(rows, __added=composed("__added"), __removed=composed("__removed"), __has=has_lines,
                    __raw=F.struct(F.size("__added").alias("a"), F.size("__removed").alias("r")))
    fps = fingerprint_diff(F.col("__added"), F.col("__removed"), key)
    rows = V.pinned(rows, __fps=F.when(F.col("__has"), fps))
    return V.pinned(
        rows,
        patch=F.when(
            F.col("__has"),
            F.struct(
                V.text(out, "$.filePath").alias("path"),
                F.when(F.coalesce(created, F.lit(False)), "create").otherwise("modify").alias("operation"),
                F.col("__fps.added").alias("added_fps"),
                F.col("__fps.removed").alias("removed_fps"),
                F.col("__raw.a").alias("added_raw"),
                F.col("__raw.r").alias("removed_raw"),
            ),
        ),
    ).drop("__ok", "__lines", "__hunk_added", "__removed", "__added", "__has", "__raw", "__fps")


def _events_of(kind: Column, tool: Column) -> Column:
    """Array of struct(event_type, status, with file path or patch) per item."""

    def ev(event_type, status=None, file=None, op=None) -> Column:
        as_col = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
        return F.struct(
            as_col(event_type).alias("event_type"),
            as_col(status).alias("status"),
            as_col(file).alias("file_path"),
            as_col(op).alias("file_operation"),
        )

    shell = tool["category"] == "shell"
    sub = tool["name"].isin(*SUBAGENT_TOOLS)
    call = (
        F.when(shell, F.array(ev("command.started", "started")))
        .when(sub, F.array(ev("subagent.started", "started")))
        .when(
            tool["name"].isin(*ASK_USER_TOOLS),
            F.array(ev("tool.started", "started", tool["path"]), ev("session.awaiting-user")),
        )
        .otherwise(F.array(ev("tool.started", "started", tool["path"])))
    )
    failed = F.col("failed")
    status = F.when(failed, "failure").otherwise("success")
    done = (
        F.when(shell, ev(F.when(failed, "command.failed").otherwise("command.completed"), status))
        .when(sub, ev("subagent.ended", status))
        .otherwise(ev(F.when(failed, "tool.failed").otherwise("tool.completed"), status, tool["path"]))
    )
    edit = ev("edit.applied", "success", F.col("patch.path"), F.col("patch.operation"))
    result = (
        F.when(F.col("denied"), F.array(ev("approval.resolved", "denied")))
        .when(F.col("interrupted_result"), F.array(ev("agent.interrupted")))
        .when(F.col("patch").isNotNull(), F.array(done, edit))
        .otherwise(F.array(done))
    )
    return (
        F.when(kind == "call", call)
        .when(kind == "result", result)
        .when(kind == "turn", F.array(ev("turn.completed")))
        .when(kind == "prompt", F.array(ev("prompt.submitted")))
        .when(kind == "interrupted", F.array(ev("agent.interrupted")))
        .when(kind.isin("api-error", "system-error"), F.array(ev("error", "failure")))
        .otherwise(F.array(ev("unknown")))
    )


def normalize_items(items: DataFrame) -> DataFrame:
    """Items to normalized event rows (one to two per item)."""
    doc = F.col("doc")
    rows = items.select("*", F.posexplode(_events_of(F.col("kind"), F.col("tool"))).alias("part", "ev"))
    et = F.col("ev.event_type")
    shell_event = et.startswith("command.")
    return rows.select(
        F.lit(PROVIDER).alias("provider"),
        F.col("type").alias("provider_event_type"),
        "session_id",
        "parent_session_id",
        F.when(F.col("kind") == "turn", F.col("message_key"))
        .otherwise(V.text(doc, "$.uuid"))
        .alias("provider_event_id"),
        F.col("version").alias("provider_version"),
        "ts_ms",
        F.col("ev.event_type").alias("event_type"),
        F.col("ev.status").alias("status"),
        "cwd",
        "git_branch",
        F.when(F.col("kind").isin("call", "turn") & (et != "session.awaiting-user"), F.col("model")).alias("model"),
        F.col("tool.name").alias("tool_name"),
        F.col("tool.category").alias("tool_category"),
        "call_id",
        F.when(shell_event, F.col("tool.executable")).alias("executable"),
        F.when(shell_event, F.col("tool.display")).alias("display"),
        F.when(shell_event, F.col("tool.redactions")).otherwise(0).alias("redactions"),
        F.col("ev.file_path").alias("file_path"),
        F.col("ev.file_operation").alias("file_operation"),
        F.when(
            F.col("kind") == "api-error",
            F.coalesce(V.text(doc, "$.apiErrorStatus"), F.lit("api-error")),
        )
        .when(F.col("kind") == "system-error", "api-error")
        .alias("error_code"),
        "file",
        "ordinal",
        (F.col("pos") * 2 + F.col("part")).alias("seq"),
    )


def usage_lines(identified: DataFrame) -> DataFrame:
    """Usage reports per assistant line, not merged yet."""
    doc = F.col("doc")
    reported = F.coalesce(
        F.schema_of_variant(V.node(doc, "$.message.usage")).startswith("OBJECT"), F.lit(False)
    )
    rows = identified.where(
        (F.col("type") == "assistant")
        & ~V.flag(doc, "$.isApiErrorMessage")
        & reported
        & F.col("message_key").isNotNull()
        & F.coalesce(F.col("message_model") != SYNTHETIC, F.lit(True))
    )
    u = lambda name: V.count(doc, f"$.message.usage.{name}")
    return rows.select(
        F.lit(PROVIDER).alias("provider"),
        "session_id",
        F.col("message_key").alias("usage_key"),
        "ts_ms",
        "model",
        (
            F.coalesce(u("input_tokens"), F.lit(0))
            + F.coalesce(u("cache_creation_input_tokens"), F.lit(0))
        ).alias("input_tokens"),
        u("output_tokens").alias("output_tokens"),
        u("cache_read_input_tokens").alias("cached_tokens"),
        F.lit(None).cast("long").alias("reasoning_tokens"),
        "file",
        "ordinal",
    )


def session_facts(identified: DataFrame, triaged: DataFrame) -> DataFrame:
    """Span, folder, branches, model, version, title and cost per session."""
    place = F.struct("file", "ordinal")
    have = lambda c: F.when(F.col(c).isNotNull(), place)
    spans = identified.groupBy("session_id").agg(
        F.min("parent_session_id").alias("parent_session_id"),
        F.min("ts_ms").alias("first_ms"),
        F.max("ts_ms").alias("last_ms"),
        F.min_by("cwd", have("cwd")).alias("cwd"),
        F.min_by("git_branch", have("git_branch")).alias("branch_first"),
        F.max_by(
            "git_branch", F.when(F.col("git_branch").isNotNull(), F.struct("ts_ms", "file", "ordinal"))
        ).alias("branch_last"),
        F.max_by("model", have("model")).alias("model"),
        F.max_by("version", have("version")).alias("provider_version"),
    )
    return spans.join(titles(triaged), "session_id", "full_outer").join(
        costs(triaged), "session_id", "full_outer"
    )


def titles(triaged: DataFrame) -> DataFrame:
    """Last title per session; one the user set beats a generated one."""
    doc = F.col("doc")
    observed = F.col("type") == "custom-title"
    title = F.when(observed, V.text(doc, "$.customTitle")).otherwise(V.text(doc, "$.aiTitle"))
    rows = triaged.where("disposition = 'title'").select(
        F.col("vendor_session").alias("session_id"),
        title.alias("title"),
        observed.alias("observed"),
        "file",
        "ordinal",
    )
    best = rows.where("session_id is not null and title is not null").groupBy("session_id").agg(
        F.max_by(F.struct("title", "observed"), F.struct("observed", "file", "ordinal")).alias("b")
    )
    return best.select(
        "session_id",
        F.col("b.title").alias("title"),
        F.when(F.col("b.observed"), "observed").otherwise("generated").alias("title_provenance"),
    )


def costs(triaged: DataFrame) -> DataFrame:
    """Latest reported cost per main session."""
    rows = triaged.where("disposition = 'cost'").select(
        F.col("vendor_session").alias("session_id"),
        V.amount(F.col("doc"), "$.totalCostUSD").alias("cost"),
        "file",
        "ordinal",
    )
    return rows.where("session_id is not null and cost is not null").groupBy("session_id").agg(
        F.max_by("cost", F.struct("file", "ordinal")).alias("cost_usd")
    )


def read(lines: DataFrame, key: bytes) -> Logs:
    triaged = triage(lines)
    identified = identify(triaged)
    block = F.col("block")
    items = V.pinned(
        line_items(identified),
        failed=V.flag(block, "$.is_error"),
        denied=V.text(F.col("doc"), "$.toolDenialKind").isNotNull(),
        interrupted_result=_result_text(block).startswith(INTERRUPT_MARKER),
    )
    patched = with_patches(items, key)
    patches = patched.where("patch is not null").select(
        F.lit(PROVIDER).alias("provider"),
        "session_id",
        "call_id",
        "ts_ms",
        "patch.*",
        "file",
        "ordinal",
        "pos",
    )
    failures = triaged.where(
        F.col("disposition").isin(
            "invalid-json", "not-an-object", "missing-field", "invalid-timestamp"
        )
    ).select("file", "ordinal", F.col("disposition").alias("reason"))
    unknown = (
        triaged.where(F.col("disposition").isin("unknown", "unknown-type"))
        .groupBy("type")
        .agg(F.count("*").alias("n"))
    )
    return Logs(
        normalize_items(patched),
        patches,
        usage_lines(identified),
        session_facts(identified, triaged),
        failures,
        unknown,
    )

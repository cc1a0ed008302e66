"""Driver tables written as raw log lines, so that the readers parse input that grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklake.bindings import Domain

BASE_MS = 1_704_067_200_000  # 2024-01-01


def _when(df_key: str, n: int, choices: list[str]):
    c = F
    for i, v in enumerate(choices[:-1]):
        c = c.when(F.col(df_key) % n == i, v)
    return c.otherwise(choices[-1])


def transcripts(d: Domain) -> DataFrame:
    """Dialect A: each conversation is one session file; every fifth is a sub-agent of the one before.

    Assistant turns call a tool and report usage, the user turn after them brings the result.
    Title, cost, heavy, unknown and broken lines are added per conversation.
    """
    iso = lambda ms: F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    c = d.conversations.withColumn("n", F.length("text")).withColumn("sub", F.col("conv_id") % 5 == 4)
    owner = F.concat(F.lit("c"), (F.col("conv_id") - F.col("sub").cast("int")).cast("string"))
    c = c.withColumn("owner", owner).withColumn(
        "file",
        F.when(F.col("sub"), F.concat(F.lit("/logs/p/"), "owner", F.lit("/subagents/agent-"), "conv_id", F.lit(".jsonl")))
        .otherwise(F.concat(F.lit("/logs/p/"), "owner", F.lit(".jsonl"))),
    )
    lines = F.split("text", "\n")
    call = F.concat(F.lit("t"), "conv_id", F.lit("-"), "turn")
    prev_call = F.concat(F.lit("t"), "conv_id", F.lit("-"), (F.col("turn") - 1).cast("string"))
    tool = _when("n", 5, ["Bash", "Edit", "AskUserQuestion", "Task", "mcp__db__query"])
    path = F.concat(F.lit("/w/r/f"), (F.col("conv_id") % 7).cast("string"), F.lit(".ts"))
    assistant = F.to_json(
        F.struct(
            F.concat(F.lit("m"), "conv_id", F.lit("-"), "turn").alias("id"),
            F.lit("model-1").alias("model"),
            F.array(
                F.struct(
                    F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("id"),
                    F.lit(None).cast("string").alias("name"),
                    F.lit(None).cast("struct<command:string,file_path:string>").alias("input"),
                ),
                F.struct(
                    F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), call.alias("id"),
                    tool.alias("name"),
                    F.struct(
                        F.when(tool == "Bash", F.concat(F.lit("cd /x && make t"), F.col("conv_id") % 9, F.lit("\n"), "text")).alias("command"),
                        F.when(tool == "Edit", path).alias("file_path"),
                    ).alias("input"),
                ),
            ).alias("content"),
            F.when(F.col("n") % 4 == 0, "end_turn").otherwise("tool_use").alias("stop_reason"),
            F.struct(
                F.col("n").alias("input_tokens"), F.floor(F.col("n") / 2).alias("output_tokens"),
                F.col("turn").alias("cache_creation_input_tokens"),
                (F.col("turn") * 10).alias("cache_read_input_tokens"),
            ).alias("usage"),
        )
    )
    answers = (F.col("turn") > 0) & (F.col("n") % 3 > 0)
    user = F.when(
        answers,
        F.to_json(
            F.struct(
                F.lit("user").alias("role"),
                F.array(
                    F.struct(
                        F.lit("tool_result").alias("type"), prev_call.alias("tool_use_id"),
                        F.col("text").alias("content"), (F.col("n") % 2 == 0).alias("is_error"),
                    )
                ).alias("content"),
            )
        ),
    ).otherwise(F.to_json(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))))
    result = F.when(
        answers & (F.col("n") % 7 > 0),
        F.to_json(
            F.struct(
                path.alias("filePath"),
                F.array(
                    F.struct(
                        F.transform(
                            lines, lambda l, i: F.concat(F.when(i % 3 == 2, "-").when(i % 3 == 1, " ").otherwise("+"), l)
                        ).alias("lines")
                    )
                ).alias("structuredPatch"),
            )
        ),
    )
    role = F.col("role")
    ts = iso(F.lit(BASE_MS) + F.col("conv_id") * 3_600_000 + F.col("turn") * 60_000)
    quote = lambda name, value: F.concat(F.lit(f',"{name}":'), value)
    text = lambda name, value: quote(name, F.concat(F.lit('"'), value, F.lit('"')))
    value = F.concat(
        F.lit('{"type":"'), role, F.lit('"'),
        text("uuid", F.concat(F.lit("u"), "conv_id", F.lit("-"), "turn")),
        text("sessionId", F.col("owner")),
        F.when(F.col("sub"), F.concat(F.lit(',"isSidechain":true'), text("agentId", F.concat(F.lit("a"), "conv_id")))).otherwise(""),
        text("timestamp", ts),
        text("cwd", F.lit("/w/r")),
        text("gitBranch", F.when(F.col("turn") < 3, "main").otherwise("feat/x")),
        F.when(role == "system", text("subtype", F.when(F.col("conv_id") % 2 == 0, "api_error").otherwise("info"))).otherwise(""),
        F.when(role == "assistant", quote("message", assistant)).when(role == "user", quote("message", user)).otherwise(""),
        F.when((role == "user") & result.isNotNull(), quote("toolUseResult", result)).otherwise(""),
        F.when((role == "user") & answers & (F.col("n") % 11 == 0), text("toolDenialKind", F.lit("user"))).otherwise(""),
        F.lit("}"),
    )
    main = c.select("file", (F.col("turn") + 1).alias("ordinal"), value.alias("value"))
    per_file = c.groupBy("file", "owner", "conv_id").agg(F.max("turn").alias("last"))
    extra = F.array(
        F.concat(F.lit('{"type":"custom-title","sessionId":"'), "owner", F.lit('","customTitle":"Title '), "conv_id", F.lit('"}')),
        F.concat(F.lit('{"type":"cost-state","sessionId":"'), "owner", F.lit('","totalCostUSD":'), F.col("conv_id") / 8, F.lit("}")),
        F.concat(F.lit('{"type":"ai-title","sessionId":"'), "owner", F.lit('","aiTitle":"Generated"}')),
        F.lit('{"type":"attachment","body":"x"}'),
        F.lit('{"type":"brand-new","x":1}'),
        F.lit('{"type":"user","message":{}}'),
        F.lit("[1,2]"),
        F.lit("{broken"),
        F.lit(""),
        F.concat(F.lit('{"type":"user","sessionId":"'), "owner", F.lit('","timestamp":"2024-02-30T00:00:00Z"}')),
        F.concat(F.lit('{"type":"novel","sessionId":"'), "owner", F.lit('","timestamp":"2024-01-01T00:00:00Z"}')),
    )
    # Conversation n gets the extra lines whose number divides it.
    extras = per_file.select("file", "last", "conv_id", F.posexplode(extra).alias("i", "value")).where(
        F.col("conv_id") % (F.col("i") + 2) == 0
    )
    return main.unionByName(
        extras.select("file", (F.col("last") + 2 + F.col("i")).cast("bigint").alias("ordinal"), "value")
    )


def rollouts(d: Domain) -> DataFrame:
    """Dialect B: each user of the events table is one rollout file.

    Clicks run commands, views change files or talk to tools, purchases complete turns and report
    the running token total, signups set the context; heavy lines are interleaved.
    """
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = d.events.select("user_id", "event_id", "event_type", k.alias("k"), ms.alias("ms"), F.floor(F.col("value") * 100).alias("v"))
    uuid = F.concat(F.lpad(F.col("user_id").cast("string"), 8, "0"), F.lit("-0000-4000-8000-000000000000"))
    file = F.concat(F.lit("/logs/2024/rollout-2024-01-01T00-00-00-"), uuid, F.lit(".jsonl"))
    iso = F.date_format(F.timestamp_millis("ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    ident = F.concat(F.lit("i"), F.col("event_id").cast("string"))
    item = lambda body: F.concat(F.lit('{"type":"item_completed","item":'), body, F.lit("}"))
    command = item(
        F.to_json(
            F.struct(
                F.lit("CommandExecution").alias("type"), ident.alias("id"),
                F.array(F.lit("/bin/zsh"), F.lit("-lc"), F.concat(F.lit("make t"), F.col("k") % 10)).alias("command"),
                F.when(F.col("k") % 3 == 0, 1).otherwise(0).alias("exit_code"),
                F.lit("completed").alias("status"),
            )
        )
    )
    change = item(
        F.concat(
            F.lit('{"type":"FileChange","id":"'), ident, F.lit('","status":"'),
            F.when(F.col("k") % 10 == 0, "declined").when(F.col("k") % 10 == 1, "failed").otherwise("completed"),
            F.lit('","changes":{"src/f'), F.col("k") % 4,
            F.lit('.ts":{"type":"update","unified_diff":"@@ -1 +1 @@\\n-old line number '), F.col("k") % 6,
            F.lit("\\n+new line number "), F.col("k"), F.lit('"},"/abs/g.ts":{"type":"'),
            F.when(F.col("k") % 2 == 0, "add").otherwise("delete"),
            F.lit('","content":"first line of g '), F.col("k"), F.lit('\\n"}}}'),
        )
    )
    mcp = item(
        F.concat(F.lit('{"type":"McpToolCall","id":"'), ident, F.lit('","server":"db","tool":"q'), F.col("k") % 2, F.lit('","status":"'), F.when(F.col("k") % 5 == 0, "failed").otherwise("completed"), F.lit('"}'))
    )
    message = (
        F.when(F.col("event_type") == "click", command)
        .when((F.col("event_type") == "view") & (F.col("k") % 2 == 0), change)
        .when(F.col("event_type") == "view", mcp)
        .when((F.col("event_type") == "error") & (F.col("k") % 2 == 0), F.lit('{"type":"turn_aborted","turn_id":"x"}'))
        .when(F.col("event_type") == "error", F.concat(F.lit('{"type":"strange'), F.col("k") % 3, F.lit('"}')))
        .otherwise(F.concat(F.lit('{"type":"task_complete","turn_id":"'), ident, F.lit('"}')))
    )
    head = lambda kind: F.concat(F.lit('{"timestamp":"'), iso, F.lit(f'","type":"{kind}","payload":'))
    context = F.concat(
        head("turn_context"), F.lit('{"cwd":"/w/u'), F.col("k") % 3, F.lit('","model":"m'), F.col("k") % 2, F.lit('"}}')
    )
    counter = F.concat(
        head("event_msg"), F.lit('{"type":"token_count","info":{"total_token_usage":{"total_tokens":'), F.col("v") % 4000,
        F.lit(',"input_tokens":'), F.col("v") % 3000, F.lit(',"cached_input_tokens":'), F.col("v") % 700,
        F.lit(',"output_tokens":'), F.col("v") % 500, F.lit(',"reasoning_output_tokens":'), F.col("v") % 90,
        F.lit('},"last_token_usage":{"input_tokens":100,"cached_input_tokens":10,"output_tokens":7,"reasoning_output_tokens":1}}}}'),
    )
    heavy = F.concat(head("response_item"), F.lit('{"body":"'), F.repeat(F.lit("x"), 300), F.lit('"}}'))
    rows = e.select(
        file.alias("file"), uuid.alias("session_from_name"), "event_id",
        F.posexplode(
            F.array(
                F.when(F.col("event_type") == "signup", context).otherwise(F.concat(head("event_msg"), message, F.lit("}"))),
                heavy,
                F.when(F.col("event_type").isin("purchase", "click"), counter),
            )
        ).alias("part", "value"),
    ).where("value is not null")
    first = e.groupBy("user_id").agg(F.min("ms").alias("ms")).select(
        file.alias("file"), uuid.alias("session_from_name"), F.lit(0).cast("bigint").alias("ordinal"),
        F.concat(
            head("session_meta"), F.lit('{"id":"'), uuid, F.lit('","timestamp":"'), iso,
            F.lit('","cwd":"/w/start","cli_version":"1.0","git":{"branch":"main"}}}'),
        ).alias("value"),
    )
    body = rows.select("file", "session_from_name", (F.col("event_id") * 3 + F.col("part") + 1).alias("ordinal"), "value")
    return body.unionByName(first)

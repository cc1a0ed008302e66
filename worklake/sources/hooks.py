"""Live hook payloads to signal events. Only ids and event names are read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklake.sources import variants as V


def normalize_hooks(payloads: DataFrame, provider: str) -> DataFrame:
    """`payloads` carry value (JSON) and received_ms; works on batch and streaming frames."""
    doc = F.col("doc")
    rows = payloads.withColumn("doc", F.try_parse_json("value")).select(
        "received_ms",
        V.text(doc, "$.session_id").alias("vendor_session"),
        V.text(doc, "$.hook_event_name").alias("hook"),
        (V.text(doc, "$.agent_id") if provider == "claude-code" else F.lit(None).cast("string")).alias("agent"),
        V.text(doc, "$.tool_name").alias("tool"),
        V.text(doc, "$.tool_use_id").alias("call"),
        V.text(doc, "$.notification_type").alias("notification"),
        V.text(doc, "$.reason").alias("reason"),
        V.text(doc, "$.cwd").alias("cwd"),
        F.coalesce(
            V.text(doc, "$.agent_transcript_path") if provider == "claude-code" else F.lit(None).cast("string"),
            V.text(doc, "$.transcript_path"),
        ).alias("transcript_path"),
    ).where("vendor_session is not null and hook is not null")
    hook = F.col("hook")
    asks = hook == "PermissionRequest"
    if provider == "claude-code":
        notifies = (hook == "Notification") & (F.col("notification") == "permission_prompt")
        ended = F.concat(F.lit("hook:SessionEnd:"), F.coalesce("reason", F.lit("other")))
    else:
        notifies = F.lit(False)
        ended = F.lit("hook:SessionEnd")
    event_type = F.when(asks | notifies, "approval.requested").when(
        hook == "SessionEnd", "session.ended"
    )
    return rows.select(
        F.lit(provider).alias("provider"),
        F.concat_ws(":", "vendor_session", "agent").alias("session_id"),
        F.when(F.col("agent").isNotNull(), F.col("vendor_session")).alias("parent_session_id"),
        F.when(hook == "SessionEnd", ended)
        .otherwise(F.concat(F.lit("hook:"), hook))
        .alias("provider_event_type"),
        F.col("received_ms").alias("ts_ms"),
        event_type.alias("event_type"),
        F.when(event_type == "approval.requested", "started").alias("status"),
        F.when(asks, F.coalesce("tool", F.lit("unknown"))).alias("tool_name"),
        F.when(asks, F.col("call")).alias("call_id"),
        "cwd",
        "transcript_path",
    )

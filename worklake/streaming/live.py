"""Live mode: micro-imports, notices raised once, quiet signals and the running-session tracker.

Every micro-batch recomputes what it touched from stored rows, so late lines need no special rule;
watermarks only bound the state of the two window queries.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from worklake.config import DAY, HOUR, LoopRules
from worklake.functions.text import content_hash
from worklake.operators.collisions import detect_collisions
from worklake.operators.ingest import insert_new
from worklake.operators.ordered import spread_runs
from worklake.operators.sessions import session_status
from worklake.sources.files import line_place

NOTICE = ["kind", "notice_key", "session_id", "rel_path", "message"]


def fingerprints(events: DataFrame) -> DataFrame:
    """Adds the fingerprint that makes repeated delivery of an event harmless."""
    optional = {
        name: F.col(col)
        for name, col in (
            ("providerEventId", "provider_event_id"), ("toolCallId", "call_id"),
            ("filePath", "file_path"), ("command", "display"),
        )
        if col in events.columns
    }
    return events.withColumn(
        "fingerprint",
        content_hash(
            {
                "v": F.lit(1),
                "provider": F.col("provider"),
                "providerEventType": F.col("provider_event_type"),
                "sessionId": F.col("session_id"),
                "eventType": F.col("event_type"),
                "at": F.col("ts_ms"),
                **optional,
            }
        ),
    )


def merge_signals(log_events: DataFrame, hook_events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Log and hook events as one, each fingerprint once; within the watermark if they are streams."""
    common = [c for c in log_events.columns if c in hook_events.columns]
    both = log_events.select(*common).unionByName(hook_events.select(*common))
    if not both.isStreaming:
        return fingerprints(both).dropDuplicates(["fingerprint"])
    return (
        fingerprints(both)
        .withColumn("ts", F.timestamp_millis("ts_ms"))
        .withWatermark("ts", late)
        .dropDuplicatesWithinWatermark(["fingerprint"])
        .drop("ts")
    )


def awaiting_notices(sessions: DataFrame, now_ms: int, window_ms: int = HOUR) -> DataFrame:
    """One notice per session that waits for its user and last event."""
    rows = sessions.where(
        (F.coalesce("ended_ms", "last_ms") >= now_ms - window_ms) & (F.col("status") == "awaiting-user")
    )
    where = F.coalesce("repo_id", F.lit("a repo"))
    return rows.select(
        F.lit("awaiting-user").alias("kind"),
        F.concat_ws(":", F.lit("awaiting-user"), "session_id", "last_ms").alias("notice_key"),
        "session_id",
        F.lit(None).cast("string").alias("rel_path"),
        F.concat(F.coalesce("title", F.lit("A session")), F.lit(" in "), where, F.lit(" needs your answer or approval.")).alias("message"),
    )


def collision_notices(
    sessions: DataFrame, patches: DataFrame, patch_lines: DataFrame, now_ms: int, window_ms: int = HOUR,
    rules: LoopRules = LoopRules(),
) -> DataFrame:
    """Collisions among the window's edits; outcomes are not known yet, so nothing counts as landed."""
    recent = sessions.where(F.coalesce("ended_ms", "last_ms") >= now_ms - window_ms)
    fresh = F.col("ts_ms") >= now_ms - window_ms
    ids = recent.select("session_id")
    p = patches.where(fresh).join(ids, "session_id", "left_semi")
    l = patch_lines.where(fresh).join(ids, "session_id", "left_semi")
    found = detect_collisions(p, l, recent, p.where("false").select("session_id", "rel_path"), rules)
    return found.select(
        F.lit("collision").alias("kind"),
        F.concat(F.lit("collision:"), "collision_key").alias("notice_key"),
        F.col("session_b").alias("session_id"),
        "rel_path",
        F.concat("rel_path", F.lit(" in "), "repo_id", F.lit(" was edited by two sessions within an hour.")).alias("message"),
    )


def new_notices(candidates: DataFrame, raised: DataFrame) -> DataFrame:
    """Notices whose key was not raised before."""
    return candidates.select(*NOTICE).dropDuplicates(["notice_key"]).join(
        raised.select("notice_key"), "notice_key", "left_anti"
    )


def raise_notices(candidates: DataFrame, raised_path: str, silent: bool = False, run: str | None = None) -> DataFrame:
    """Adds new notices to the raised table; `silent` marks history as known at start.

    A run owns one folder of the table. A retry under the same `run` (a micro-batch passes its id)
    compares with the other runs only and writes its folder anew, so it returns what the first try
    raised, even where that failed between the write and the notification.
    """
    spark = candidates.sparkSession
    run = run or uuid.uuid4().hex
    schema = "kind string, notice_key string, session_id string, rel_path string, message string, silent boolean, run string"
    raised = spark.read.schema(schema).parquet(raised_path) if _exists(spark, raised_path) else spark.createDataFrame([], schema)
    fresh = new_notices(candidates, raised.where(F.col("run") != run)).select(
        "kind", "notice_key", "session_id", "rel_path", "message", F.lit(silent).alias("silent")
    )
    fresh.write.mode("overwrite").parquet(f"{raised_path}/run={run}")
    return spark.read.schema(schema).parquet(raised_path).where(F.col("run") == run)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def append_new_events(batch: DataFrame, table: str) -> None:
    """Keyed idempotent append of one micro-batch to a table in folders per day.

    A fingerprint covers the time, so equal events share their day: only the days between the batch's
    first and last are compared.
    """
    spark = batch.sparkSession
    rows = fingerprints(batch).select(
        "*", F.col("fingerprint").alias("event_id"), F.floor(F.col("ts_ms") / DAY).cast("int").alias("day")
    )
    stored = rows.where("false")
    if _exists(spark, table):
        first, last = rows.agg(F.min("day"), F.max("day")).first()
        days = F.lit(False) if first is None else F.col("day").between(first, last)
        stored = spark.read.parquet(table).where(days | F.col("day").isNull())
    fresh = insert_new(rows, stored, ["fingerprint"], ["file", "ordinal", "seq"])
    fresh.write.mode("append").partitionBy("day").parquet(table)


def import_stream(
    spark: SparkSession,
    root: str,
    normalize: Callable[[DataFrame], DataFrame],
    table: str,
    checkpoint: str,
    after: Callable[[DataFrame], None] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Imports log chunks as they arrive under `root`.

    Collectors drop grown logs as new chunk files. `normalize` maps lines (file, ordinal, value) to
    events; `after` gets the sessions a batch touched, to refresh status and raise notices.
    """
    lines = (
        spark.readStream.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.jsonl")
        .text(root)
        .select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.col("_metadata.file_block_length").alias("block_length"), "value",
        )
    )

    def load(batch: DataFrame, _: int) -> None:
        lines = batch.select("file", line_place("block", "block_length").alias("ordinal"), "value")
        events = normalize(lines).persist()
        append_new_events(events, table)
        if after is not None:
            after(events.select("session_id").distinct())
        events.unpersist()

    return (
        lines.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "2 seconds"}))
        .start()
    )


def refresh_status(events: DataFrame, touched: DataFrame) -> DataFrame:
    """Status and last event of the touched sessions, from all their stored events."""
    own = events.join(touched.select("session_id"), "session_id", "left_semi")
    last = own.groupBy("session_id").agg(F.max("ts_ms").alias("last_ms"))
    return session_status(own).join(last, "session_id")


def activity_windows(events: DataFrame, keys: list[str], gap_ms: int, late: str = "10 minutes") -> DataFrame:
    """Stretches of activity per key that end after a gap without events; batch or stream.

    With a 10-minute gap per session this is the running-session tracker; with two minutes, the end of
    a stretch is the signal to derive again what the key covers. A stream keeps the open stretches of a
    key in one task, so give it keys that spread, such as the repository; a batch may use any key, as
    no task there holds more than a bounded piece of it.
    """
    if not events.isStreaming:
        runs = spread_runs(events, keys, "ts_ms", gap_ms - 1)
        return runs.select(*keys, F.col("first").alias("start_ms"), (F.col("last") + gap_ms).alias("end_ms"), "events")
    timed = events.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", late)
    window = F.session_window("ts", f"{gap_ms} milliseconds")
    return timed.groupBy(*keys, window.alias("w")).agg(F.count("*").alias("events")).select(
        *keys, F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), "events"
    )

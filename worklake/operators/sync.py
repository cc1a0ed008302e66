"""Detector results against their stored snapshot. Each function returns the new snapshot."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def sync_loops(stored: DataFrame, detected: DataFrame, now_ms: int) -> DataFrame:
    """New loops open, re-detected ones are updated, vanished open ones resolve.

    A user's dismissal stays; a resolved loop that is detected again opens. `change` says what
    happened: opened, reopened, updated, resolved, kept. `stored` adds state and resolved_by to
    the detected columns.
    """
    facts = [c for c in detected.columns if c != "loop_key"]
    s, n = stored.alias("s"), detected.withColumn("__new", F.lit(True)).alias("n")
    j = s.join(n, F.col("s.loop_key") == F.col("n.loop_key"), "full_outer")
    known, seen = F.col("s.loop_key").isNotNull(), F.coalesce("n.__new", F.lit(False))
    old = F.col("s.state")
    change = (
        F.when(~known, "opened")
        .when(seen & (old == "resolved"), "reopened")
        .when(seen, "updated")
        .when(old == "open", "resolved")
        .otherwise("kept")
    )
    return j.select(
        F.coalesce("s.loop_key", "n.loop_key").alias("loop_key"),
        *[F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in facts],
        F.when(change.isin("opened", "reopened"), "open")
        .when(change == "resolved", "resolved")
        .otherwise(old)
        .alias("state"),
        F.when(change == "resolved", "auto")
        .when(change.isin("opened", "reopened"), F.lit(None).cast("string"))
        .otherwise(F.col("s.resolved_by"))
        .alias("resolved_by"),
        change.alias("change"),
        F.lit(now_ms).alias("synced_ms"),
    )


def sync_report(synced: DataFrame) -> DataFrame:
    return synced.agg(
        F.count_if(F.col("change") == "opened").alias("opened"),
        F.count_if(F.col("change") == "resolved").alias("resolved"),
    )


def set_loop_state(loops: DataFrame, actions: DataFrame) -> DataFrame:
    """User actions (loop_key, action in dismissed/resolved/open, reason) applied to the snapshot."""
    a = actions.select("loop_key", "action", "reason")
    j = loops.join(a, "loop_key", "left")
    act = F.col("action")
    resolved_by = F.when(act == "resolved", "user").when(act.isNull(), F.col("resolved_by"))
    reason = F.when(act == "dismissed", F.col("reason"))
    if "dismiss_reason" in loops.columns:
        reason = F.when(act.isNull(), F.col("dismiss_reason")).otherwise(reason)
    return j.select(
        *[c for c in loops.columns if c not in ("state", "resolved_by", "dismiss_reason")],
        F.coalesce("action", "state").alias("state"),
        resolved_by.alias("resolved_by"),
        reason.alias("dismiss_reason"),
    )


def sync_insights(stored: DataFrame, detected: DataFrame) -> DataFrame:
    """Upsert; dismissed ones stay even when gone, others vanish with their cause."""
    facts = [c for c in detected.columns if c not in ("insight_key", "created_ms")]
    s, n = stored.alias("s"), detected.withColumn("__new", F.lit(True)).alias("n")
    j = s.join(n, F.col("s.insight_key") == F.col("n.insight_key"), "full_outer")
    seen = F.coalesce("n.__new", F.lit(False))
    return j.where(seen | F.col("s.dismissed_ms").isNotNull()).select(
        F.coalesce("s.insight_key", "n.insight_key").alias("insight_key"),
        *[F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in facts],
        F.coalesce("s.created_ms", "n.created_ms").alias("created_ms"),
        F.col("s.dismissed_ms").alias("dismissed_ms"),
    )


def dismiss_insights(insights: DataFrame, keys: DataFrame, now_ms: int) -> DataFrame:
    flag = keys.select("insight_key", F.lit(now_ms).alias("__at")).distinct()
    return insights.join(flag, "insight_key", "left").withColumn(
        "dismissed_ms", F.coalesce("__at", "dismissed_ms")
    ).drop("__at")


def replace_all(rows: DataFrame, key: list[str], path: str) -> None:
    """Gives a derived table a new version; a repeated key keeps one row.

    A version is a folder of its own, complete once its marker is written, so `rows` may read the
    version it replaces, readers always find a whole one, and a failed write changes nothing.
    """
    value = F.struct(*rows.columns)
    folder = f"{path}/{time.time_ns():020d}-{uuid.uuid4().hex}"
    rows.groupBy(*key).agg(F.min(value).alias("r")).select("r.*").write.parquet(folder)


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Folders of complete versions, oldest first."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folders = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = folders.globStatus(hadoop(f"{path}/*/_SUCCESS"))
    return sorted(s.getPath().getParent().toString() for s in found or [])


def current(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """The last complete version of a derived table; where there is none yet, an empty table of `schema`."""
    done = _versions(spark, path)
    if not done and schema is not None:
        return spark.createDataFrame([], schema)
    return spark.read.parquet(done[-1])


def drop_versions(spark: SparkSession, path: str, keep_ms: int, now_ms: int) -> int:
    """Deletes complete versions that were replaced over `keep_ms` ago; returns how many.

    A version is in use until the next one is complete, so what counts is the age of its successor.
    """
    done = _versions(spark, path)
    made = [int(folder.rsplit("/", 1)[1].split("-", 1)[0]) // 1_000_000 for folder in done]
    gone = [folder for folder, next_ms in zip(done, made[1:], strict=False) if next_ms < now_ms - keep_ms]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in gone:
        hadoop(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop(folder), True)
    return len(gone)

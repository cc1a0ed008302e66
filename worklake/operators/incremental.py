"""Incremental runs: only changed files are read, only changed repositories derived, only their partitions written.

Stored tables are partitioned by what changes together: log rows by a bucket of their file, outcomes by
repository. A run compares what there is with what the last run has seen, replaces the partitions of
what differs, and then records what it has seen. A run that fails in between records nothing, so the
next one does the same work again; replacing a partition twice gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklake.config import OutcomeRules
from worklake.operators.matching import changed_repos, classify, input_keys
from worklake.operators.ordered import materialize
from worklake.operators.sync import current, replace_all
from worklake.sources.files import line_place, plan_reads

FILES = "path string, inode long, byte_offset long, mtime_ms long, parser_version string"
KEYS = "repo_id string, input_key string"
#: Partitions of stored log rows; a changed file replaces the one it falls into.
BUCKETS = 256


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def replace_partitions(rows: DataFrame, path: str, *by: str) -> None:
    """Replaces the partitions that `rows` has rows for; all others stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def drop_partitions(spark: SparkSession, path: str, by: str, values: list[str]) -> None:
    """Removes whole partitions, for what there is no more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for value in values:
        folder = hadoop(f"{path}/{by}={escape(value)}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def list_files(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """path, inode (0: stores have none), size and mtime_ms of the log files; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return found.select(
        "path", F.lit(0).cast("long").alias("inode"), F.col("length").alias("size"),
        F.unix_millis("modificationTime").alias("mtime_ms"),
    )


def plan_files(listing: DataFrame, seen: DataFrame, parser_version: str) -> DataFrame:
    """`plan_reads`, and `gone` for files that were there; a file of the same size but a later time is reset."""
    now = plan_reads(listing, seen.drop("mtime_ms"), parser_version).join(seen.select("path", F.col("mtime_ms").alias("was_ms")), "path", "left")
    touched = (F.col("action") == "skip") & (F.col("was_ms") != F.col("mtime_ms"))
    plan = now.select("path", "size", "mtime_ms", F.when(touched, "reset").otherwise(F.col("action")).alias("action"))
    lost = seen.join(listing, "path", "left_anti").select("path", F.lit(0).cast("long").alias("size"), "mtime_ms", F.lit("gone").alias("action"))
    return plan.unionByName(lost)


def refresh_rows(
    spark: SparkSession, root: str, store: str, parser_version: str, parse: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS,
    pattern: str = "*.jsonl",
) -> DataFrame:
    """Brings the stored rows of the logs under `root` up to date; returns the plan (path, action).

    `parse` maps lines (file, ordinal, value) to rows with `file`. Unchanged files are not read. The
    paths of changed files pass the driver, as all paths of a Spark file scan do; lines don't.
    """
    seen = current(spark, f"{store}/files", FILES)
    plan = materialize(plan_files(list_files(spark, root, pattern), seen, parser_version), "read-plan")
    work = plan.where("action <> 'skip'")
    paths = [r.path for r in work.where("action <> 'gone'").select("path").collect()]
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")
    if not work.isEmpty():
        hit = work.select(bucket("path").alias("bucket")).distinct()
        parts = []
        if exists(spark, f"{store}/rows"):
            stored = spark.read.parquet(f"{store}/rows").join(F.broadcast(hit), "bucket", "left_semi")
            parts.append(stored.join(work.select(F.col("path").alias("file")), "file", "left_anti"))
        if paths:
            lines = spark.read.text(paths).select(
                F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                F.col("_metadata.file_block_length").alias("block_length"), "value",
            )
            fresh = parse(lines.select("file", line_place("block", "block_length").alias("ordinal"), "value"))
            parts.append(fresh.withColumn("bucket", bucket("file")))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
        # What is replaced is read as well, so it is written down first; a bucket that got empty goes.
        rows = materialize(rows, "bucket-rows")
        replace_partitions(rows, f"{store}/rows", "bucket")
        empty = hit.join(rows.select("bucket").distinct(), "bucket", "left_anti")
        drop_partitions(spark, f"{store}/rows", "bucket", [str(r.bucket) for r in empty.collect()])
        known = plan.where("action <> 'gone'").select(
            "path", F.lit(0).cast("long").alias("inode"), F.col("size").alias("byte_offset"), "mtime_ms", F.lit(parser_version).alias("parser_version")
        )
        replace_all(known, ["path"], f"{store}/files")
    return plan.select("path", "action")


def refresh_outcomes(
    spark: SparkSession, store: str, subjects: DataFrame, lines: DataFrame, hits: DataFrame, snapshots: DataFrame,
    refs: DataFrame, files: DataFrame, key: list[str], config: str = "1", reverted: DataFrame | None = None,
    rules: OutcomeRules = OutcomeRules(),
) -> DataFrame:
    """Brings the stored outcomes (partitioned by repository) up to date; returns the repositories worked out.

    A repository is worked out where its edits, refs, files or the configuration differ from the last
    run's. Outcomes of repositories without edits are removed.
    """
    known = current(spark, f"{store}/keys", KEYS)
    patches = subjects.withColumn("patch_id", F.concat_ws("|", *key))
    keys = materialize(input_keys(patches, refs, files, config), "input-keys")
    changed = materialize(changed_repos(keys, known).select("repo_id"), "changed-repos")
    gone = [r.repo_id for r in known.join(keys, "repo_id", "left_anti").select("repo_id").collect()]
    work = not changed.isEmpty()
    if work:
        mine = lambda df: df.join(changed, "repo_id", "left_semi")
        out = classify(mine(subjects), mine(lines), mine(hits), mine(snapshots), key, None if reverted is None else mine(reverted), rules=rules)
        replace_partitions(out, f"{store}/outcomes", "repo_id")
    drop_partitions(spark, f"{store}/outcomes", "repo_id", gone)
    if work or gone:
        replace_all(keys, ["repo_id"], f"{store}/keys")
    return changed

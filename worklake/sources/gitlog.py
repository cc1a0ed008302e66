"""Exported history: `log -p -U0` text to commits and added lines; refs and file snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worklake.functions.paths import diff_path
from worklake.functions.redact import redact_text
from worklake.functions.text import is_significant, line_fingerprint, nfc, split_lines, squeeze
from worklake.sources.variants import pinned

COMMIT_MARK = "\u0001"
FIELD_MARK = "\u0002"


def significant(lines: DataFrame, text: Column) -> DataFrame:
    """Adds `norm`, the canonical line, and keeps lines that carry a signal.

    The canonical form is pinned: the filter would otherwise repeat its regex per condition.
    """
    return pinned(lines, norm=squeeze(text)).where(is_significant(F.col("norm")))


def read_patch_log(spark: SparkSession, root: str) -> DataFrame:
    """One record per commit; the text source splits on the commit mark, so records are whole."""
    return (
        spark.read.option("lineSep", COMMIT_MARK)
        .text(root)
        .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("record"))
        .where("record != ''")
    )


def parse_commits(records: DataFrame) -> DataFrame:
    """repo_id, sha, commit_ms, subject (redacted, 120 characters) and the patch text."""
    head = F.get(F.split("record", "\n", 2), F.lit(0))
    fields = F.split(head, FIELD_MARK)
    return records.select(
        "repo_id",
        F.get(fields, F.lit(0)).alias("sha"),
        (F.get(fields, F.lit(1)).cast("long") * 1000).alias("commit_ms"),
        redact_text(F.coalesce(F.get(fields, F.lit(2)), F.lit(""))).alias("subject"),
        F.get(F.split("record", "\n", 2), F.lit(1)).alias("patch"),
    )


def added_lines(commits: DataFrame, touched: DataFrame, key: bytes) -> DataFrame:
    """Added lines of touched files as (repo_id, rel_path, fp, sha, commit_ms).

    Files are cut out of the patch first and filtered by path before any line is exploded or
    hashed. The header ends at the first hunk, so content such as `++x` is never a header.
    """
    section = F.explode(F.split(F.concat(F.lit("\n"), F.coalesce("patch", F.lit(""))), "\ndiff --git "))
    files = commits.select("repo_id", "sha", "commit_ms", section.alias("section")).withColumn(
        "header", F.get(F.split("section", "\n@@", 2), F.lit(0))
    )
    files = files.withColumn(
        "rel_path",
        diff_path(F.nullif(F.regexp_extract("header", r"(?m)^\+\+\+ (.*)$", 1), F.lit(""))),
    ).where("rel_path is not null")
    wanted = touched.select("repo_id", "rel_path").distinct()
    kept = files.join(wanted, ["repo_id", "rel_path"], "left_semi")
    body = F.get(F.split("section", "\n@@", 2), F.lit(1))
    lines = kept.select(
        "repo_id", "rel_path", "sha", "commit_ms",
        F.explode(F.filter(F.split(nfc(body), "\n"), lambda l: l.startswith("+"))).alias("line"),
    )
    rows = significant(lines, F.col("line").substr(F.lit(2), F.length("line")))
    return rows.select(
        "repo_id", "rel_path", line_fingerprint(F.col("norm"), key).alias("fp"), "sha", "commit_ms"
    )


def _files(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files.select(F.col("path").alias("file"), text.alias("content"))


def read_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """Files under a folder as text, whole. Binary ones (NUL byte) are in `skipped_snapshots`."""
    return _files(spark, root).where(F.instr("content", "\0") == 0)


def skipped_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """Files that `read_snapshots` leaves out, with the reason."""
    return _files(spark, root).where(F.instr("content", "\0") > 0).select("file", F.lit("binary").alias("reason"))


def snapshot_lines(snapshots: DataFrame, key: bytes) -> DataFrame:
    """Distinct fingerprints per (repo_id, rel_path, kind) of current file contents."""
    lines = snapshots.select(
        "repo_id", "rel_path", "kind", F.explode(split_lines(nfc(F.col("content")))).alias("line")
    )
    rows = significant(lines, F.col("line"))
    # Hashed before the shuffle: only fingerprints travel, never text.
    return rows.select(
        "repo_id", "rel_path", "kind", line_fingerprint(F.col("norm"), key).alias("fp")
    ).distinct()


def edit_lines(edits: DataFrame, key: bytes, keep: list[str]) -> DataFrame:
    """Distinct significant lines of each edit text with first-occurrence order."""
    lines = edits.select(*keep, F.posexplode(split_lines(nfc(F.col("content")))).alias("pos", "line"))
    rows = significant(lines, F.col("line"))
    return (
        rows.select(*keep, "pos", line_fingerprint(F.col("norm"), key).alias("fp"))
        .groupBy(*keep, "fp")
        .agg(F.min("pos").alias("ordinal"))
    )

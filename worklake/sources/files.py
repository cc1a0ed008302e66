"""Log file scans: raw lines with file, order and precedence; incremental file selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from worklake.operators.ordered import ROW_BITS, fill_last

SESSION_ID_IN_NAME = (
    r"([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\.jsonl$"
)


def line_place(block: str, block_length: str) -> Column:
    """A line's place in its file as one long: number of its block, then row number in the task.

    Lines of a block are read by one task in order, so places rise along the file, with gaps. All
    blocks of a file but the last have one length; dividing by a shorter last one only gives a larger
    number. Works in batches and in micro-batches, on lines as they are scanned.
    """
    length = F.greatest(F.col(block_length), F.lit(1))
    number = F.least(F.floor(F.col(block) / length), F.lit((1 << (62 - ROW_BITS)) - 1))
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return F.shiftleft(number, ROW_BITS).bitwiseOR(row)


def read_lines(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """All lines under a folder: file, file_time, ordinal and text. One scan, no shuffle.

    The ordinal orders the lines of a file (`line_place`); `line_numbers` makes it a line number for
    the rows that need one.
    """
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .text(root)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_modification_time").alias("file_time"),
            F.col("_metadata.file_block_start").alias("block"),
            F.col("_metadata.file_block_length").alias("block_length"),
            "value",
        )
        .select("file", "file_time", line_place("block", "block_length").alias("ordinal"), "value")
    )


def line_numbers(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Adds line_no (from 0) to rows that carry file and ordinal, from counts per file and block."""
    block = F.shiftright("ordinal", ROW_BITS)
    base = lines.groupBy("file", block.alias("__block")).agg(
        F.min("ordinal").alias("__first"), F.count("*").alias("__n")
    )
    before = Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    shift = base.select("file", "__block", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__skip"))
    return (
        rows.withColumn("__block", block)
        .join(shift, ["file", "__block"])
        .withColumn("line_no", F.col("ordinal") - F.col("__first") + F.col("__skip"))
        .drop("__block", "__first", "__skip")
    )


def first_lines(lines: DataFrame) -> DataFrame:
    """file and the ordinal of its first line, reduced where the lines are read."""
    return lines.groupBy("file").agg(F.min("ordinal").alias("ordinal"))


def transcript_order(lines: DataFrame) -> DataFrame:
    """Dialect A precedence: main files before sub-agent files, each oldest first.

    One sortable column; the smallest owns copied history.
    """
    sub = F.col("file").contains("/subagents/")
    return lines.withColumn("is_sub", sub).withColumn(
        "precedence", F.struct(sub.alias("sub"), F.unix_millis("file_time").alias("t"), "file")
    )


def rollout_order(lines: DataFrame) -> DataFrame:
    """Dialect B precedence: live before archived, then path (which is time) order."""
    archived = F.col("file").contains("/archived_sessions/")
    return (
        lines.where(F.element_at(F.split("file", "/"), -1).startswith("rollout-"))
        .withColumn(
            "session_from_name",
            F.nullif(F.regexp_extract("file", SESSION_ID_IN_NAME, 1), F.lit("")),
        )
        .withColumn("precedence", F.struct(archived.alias("archived"), "file"))
    )


def plan_reads(listing: DataFrame, ingested: DataFrame, parser_version: str) -> DataFrame:
    """Per file: read (new), tail (grown), reset (rewritten or other parser), skip (unchanged).

    `listing` has path, inode, size; `ingested` has path, inode, byte_offset, parser_version.
    """
    prev = ingested.select(
        "path",
        F.col("inode").alias("prev_inode"),
        F.col("byte_offset"),
        F.col("parser_version").alias("prev_version"),
    )
    joined = listing.join(prev, "path", "left")
    rewritten = (F.col("prev_inode") != F.col("inode")) | (F.col("size") < F.col("byte_offset"))
    return joined.withColumn(
        "action",
        F.when(F.col("byte_offset").isNull(), "read")
        .when(rewritten | (F.col("prev_version") != parser_version), "reset")
        .when(F.col("size") == F.col("byte_offset"), "skip")
        .otherwise("tail"),
    )


def sticky(lines: DataFrame, values: dict, chunk_bits: int = 16) -> DataFrame:
    """Last non-null values at or before each line of its file, for files of any length."""
    return fill_last(lines, ["file"], F.shiftright("ordinal", chunk_bits), ["ordinal"], values)

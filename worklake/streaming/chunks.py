"""Logs that grow: chunks of a log are read one after another, as if they were one file.

What a parser knows of a log at the end of a chunk (its header, the context in force, the last token
counter, the next line's place) is one row of a state table. A batch of chunks is read against the
state of the batch before and gives the next one. Lines of earlier chunks are never read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from worklake.operators.ordered import materialize
from worklake.sources import dialect_b as B
from worklake.sources.dialect_a import Logs
from worklake.sources.files import line_place, rollout_order
from worklake.streaming.live import _exists, append_new_events

CHUNK_NAME = r"\.(\d+)\.jsonl$"
#: Versions of the state that are kept: a retried batch reads the one before its own.
KEPT_STATES = 3


def chunk_lines(lines: DataFrame) -> DataFrame:
    """Lines of chunk files `<log>.<number>.jsonl` with log (the path without number) and chunk number."""
    number = F.nullif(F.regexp_extract("file", CHUNK_NAME, 1), F.lit(""))
    return lines.withColumn("chunk", F.coalesce(number.cast("long"), F.lit(0))).withColumn(
        "file", F.regexp_replace("file", CHUNK_NAME, ".jsonl")
    )


def in_log_order(lines: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines (file, chunk, ordinal, ...) placed in their log: chunks by number, behind all that the state has seen.

    One small row a chunk is worked out, written and joined back. The second frame has the places (file,
    ordinal) of each chunk's first and last line, so that nothing about a log's ends reads the lines again.
    """
    sizes = lines.groupBy("file", "chunk").agg(F.min("ordinal").alias("__first"), (F.max("ordinal") + 1).alias("__n"))
    before = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.join(state.select("file", "next_ordinal"), "file", "left").select(
        "file", "chunk", "__first", "__n",
        (F.coalesce("next_ordinal", F.lit(0)) + F.coalesce(F.sum("__n").over(before), F.lit(0))).alias("__base"),
    )
    places = materialize(placed, "chunk-places")
    ends = F.array(F.col("__base") + F.col("__first"), F.col("__base") + F.col("__n") - 1)
    rows = (
        lines.join(places.select("file", "chunk", "__base"), ["file", "chunk"])
        .withColumn("ordinal", F.col("ordinal") + F.col("__base"))
        .drop("chunk", "__base")
    )
    return rows, places.select("file", F.explode(ends).alias("ordinal"))


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], B.STATE)


def read_chunks(lines: DataFrame, state: DataFrame, key: bytes) -> tuple[Logs, DataFrame]:
    """What a batch of chunks (file, chunk, ordinal, value) adds, and the state after it.

    The state is written; give the one this returns to the next batch. So are the parsed lines and the
    headers: texts are parsed once, for the state and for all that is read from the batch.
    """
    placed, ends = in_log_order(lines, state)
    if "session_from_name" not in placed.columns:
        placed, ends = rollout_order(placed), rollout_order(ends)
    triaged = materialize(B.triage(placed), "chunk-lines")
    heads = materialize(B.log_heads(triaged, ends, state), "log-heads")
    own = materialize(B.counter_lines(triaged, heads), "log-counters")
    return B.read_triaged(triaged, heads, key, state), materialize(B.carry(own, ends, heads, state), "log-state")


def _version(spark: SparkSession, path: str, before: int) -> tuple[DataFrame, list[int]]:
    """The state that the last batch before this one left, and the numbers of older ones."""
    if not _exists(spark, path):
        return empty_state(spark), []
    known = sorted(r.batch for r in spark.read.parquet(path).select("batch").distinct().collect() if r.batch < before)
    return (spark.read.schema(B.STATE).parquet(f"{path}/batch={known[-1]}") if known else empty_state(spark)), known


def import_chunks(
    spark: SparkSession,
    root: str,
    key: bytes,
    store: str,
    checkpoint: str,
    after: Callable[[DataFrame], None] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Imports chunk files as they arrive under `root` into folders of `store`.

    `events` is keyed and in folders per day; `patches`, `usage`, `failures` and `state` have one folder
    per micro-batch, which a retry writes anew, so each chunk counts once. `after` gets the sessions of
    a batch.
    """
    lines = (
        spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(root).select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.col("_metadata.file_block_length").alias("block_length"), "value",
        )
    )

    def load(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        placed = batch.select("file", line_place("block", "block_length").alias("ordinal"), "value")
        state, older = _version(own, f"{store}/state", number)
        logs, after_state = read_chunks(chunk_lines(placed), state, key)
        append_new_events(logs.events, f"{store}/events")
        for name, rows in (("patches", logs.patches), ("usage", logs.usage), ("failures", logs.failures)):
            rows.write.mode("overwrite").parquet(f"{store}/{name}/batch={number}")
        after_state.write.mode("overwrite").parquet(f"{store}/state/batch={number}")
        for gone in older[:-KEPT_STATES]:
            _remove(own, f"{store}/state/batch={gone}")
        if after is not None:
            after(logs.events.select("session_id").distinct())

    return (
        lines.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "2 seconds"})).start()
    )


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)

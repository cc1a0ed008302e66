"""Token usage: counters to deltas, merged reports, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worklake.operators.ordered import fill_last

TOKENS = ["input_tokens", "output_tokens", "cached_tokens", "reasoning_tokens"]
PARTS = ["input", "cached", "output", "reasoning"]


def changed_counters(counters: DataFrame, chunk_bits: int = 16, before: DataFrame | None = None) -> DataFrame:
    """Cumulative counters without those that repeat the total of the line before.

    `before` has the last changed counters (file, total, parts) of files whose earlier lines were counted
    already; they come first, with ordinal -1.
    """
    if before is not None:
        last = before.select("file", "total", *PARTS, F.lit(-1).cast("long").alias("ordinal"))
        counters = counters.unionByName(last, allowMissingColumns=True)
    slot = F.shiftright("ordinal", chunk_bits)
    seen = fill_last(counters, ["file"], slot, ["ordinal"], {"before": F.col("total")}, strict=True)
    return seen.where(F.col("before").isNull() | (F.col("total") != F.col("before"))).drop("before")


def counter_deltas(counters: DataFrame, chunk_bits: int = 16, before: DataFrame | None = None) -> DataFrame:
    """Cumulative counters to usage rows: file, session_id, ordinal, ts_ms, model, total, parts.

    A repeated total adds nothing; a grown one adds its difference; a first or smaller one counts
    the call's own usage. Repeats go first, so each kept line is compared with the last kept one
    (`before`, as in `changed_counters`, for the first line of a file that began earlier).
    """
    fresh = changed_counters(counters, chunk_bits, before)
    slot = F.shiftright("ordinal", chunk_bits)
    kept = fill_last(
        fresh, ["file"], slot, ["ordinal"], {"prev": F.struct("total", *PARTS)}, strict=True
    )
    grown = F.col("total") > F.col("prev.total")
    delta = lambda p: F.when(
        F.coalesce(grown, F.lit(False)), F.greatest(F.lit(0), F.col(p) - F.col(f"prev.{p}"))
    ).otherwise(F.col(f"last_{p}"))
    return kept.where("ordinal >= 0").select(
        "session_id",
        F.concat_ws(":", "session_id", F.lit("cum"), "total").alias("usage_key"),
        "ts_ms",
        "model",
        F.greatest(F.lit(0), delta("input") - delta("cached")).alias("input_tokens"),
        delta("output").alias("output_tokens"),
        delta("cached").alias("cached_tokens"),
        delta("reasoning").alias("reasoning_tokens"),
        "file",
        "ordinal",
    )


def merge_usage(usage: DataFrame) -> DataFrame:
    """One row per (provider, session, key): the largest value of each field, first model."""
    return usage.groupBy("provider", "session_id", "usage_key").agg(
        F.min("ts_ms").alias("ts_ms"),
        F.min_by("model", F.when(F.col("model").isNotNull(), F.struct("ts_ms", "ordinal"))).alias("model"),
        *[F.max(c).alias(c) for c in TOKENS],
    )


def usage_totals(sessions: DataFrame, merged: DataFrame) -> DataFrame:
    """Totals and coverage per session; a session without records has coverage none and no totals."""
    sums = merged.groupBy("session_id").agg(
        F.count("*").alias("usage_records"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOKENS],
    )
    joined = sessions.join(sums, "session_id", "left").fillna({"usage_records": 0})
    return joined.withColumn(
        "usage_coverage", F.when(F.col("usage_records") > 0, "complete").otherwise("none")
    )

"""Keyed idempotent loading: copied history, upserts that keep what others own, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from worklake.operators.ordered import join_known


def event_copy_key() -> Column:
    """Vendor id, type and call; events without an id are the same at the same instant and types."""
    with_id = F.concat_ws("\0", F.lit("e"), "provider_event_id", "event_type", F.coalesce("call_id", F.lit("")))
    without = F.concat_ws("\0", F.lit("t"), "ts_ms", "provider_event_type", "event_type")
    return F.when(F.col("provider_event_id").isNotNull(), with_id).otherwise(without)


def patch_copy_key() -> Column:
    """Call and path; patches without a call id are never copies."""
    return F.when(F.col("call_id").isNotNull(), F.concat_ws("\0", F.lit("p"), "call_id", "path"))


def usage_copy_key() -> Column:
    return F.concat_ws("\0", F.lit("u"), "usage_key")


def drop_copies(
    rows: DataFrame, key: Column, precedence: list[str], owners: DataFrame | None = None
) -> DataFrame:
    """Keeps rows of the session that first showed the key; later sessions hold copies.

    Owners come from a map-side combined aggregate, so a key copied into very many sessions stays
    small in the shuffle. `owners` (provider, key, session_id) are sessions that already store it.
    """
    keyed = rows.withColumn("__key", key)
    free = keyed.where("__key is null").drop("__key")
    bound = keyed.where("__key is not null")
    first = bound.groupBy("provider", "__key").agg(
        F.min_by("session_id", F.struct(*precedence)).alias("__owner")
    )
    kept = bound.join(first, ["provider", "__key"])
    mine = F.col("session_id") == F.col("__owner")
    if owners is not None:
        stored = owners.select(
            "provider", F.col("key").alias("__key"), "session_id", F.lit(True).alias("__mine")
        ).distinct()
        any_owner = stored.select("provider", "__key", F.lit(True).alias("__stored")).distinct()
        kept = kept.join(stored, ["provider", "__key", "session_id"], "left").join(
            any_owner, ["provider", "__key"], "left"
        )
        mine = F.when(F.col("__stored"), F.coalesce("__mine", F.lit(False))).otherwise(mine)
    kept = kept.where(mine).select(*rows.columns)
    return kept.unionByName(free)


def insert_new(batch: DataFrame, existing: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows whose key is not stored yet, the first copy of each."""
    value = F.struct(*batch.columns)
    first = batch.groupBy(*key).agg(F.min_by(value, F.struct(*order)).alias("__row")).select("__row.*")
    return first.join(existing.select(*key), key, "left_anti").select(*batch.columns)


def insert_report(batch: DataFrame, inserted: DataFrame) -> DataFrame:
    """inserted and duplicates as one row."""
    mark = lambda df, kept: df.select(F.lit(kept).alias("kept"))
    rows = mark(batch, 0).unionByName(mark(inserted, 1))
    return rows.agg(
        F.sum("kept").alias("inserted"),
        (F.count_if(F.col("kept") == 0) - F.sum("kept")).alias("duplicates"),
    )


def upsert(
    stored: DataFrame,
    new: DataFrame,
    key: list[str],
    keep_stored: list[str] = (),
    fill_only: list[str] = (),
) -> DataFrame:
    """Full-outer merge by key.

    Columns in `keep_stored` belong to another stage and never change once stored; those in
    `fill_only` keep the stored value unless it is missing; others take the new value when given.
    """
    left = stored.alias("s")
    right = new.alias("n")
    cond = [F.col(f"s.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key]
    joined = left.join(right, cond, "full_outer")
    is_new = F.coalesce(*[F.col(f"s.{k}") for k in key]).isNull()
    out = []
    for c in stored.columns:
        s = F.col(f"s.{c}")
        if c in key:
            out.append(F.coalesce(s, F.col(f"n.{c}")).alias(c))
        elif c not in new.columns:
            out.append(s.alias(c))
        elif c in keep_stored:
            out.append(F.when(is_new, F.col(f"n.{c}")).otherwise(s).alias(c))
        elif c in fill_only:
            out.append(F.coalesce(s, F.col(f"n.{c}")).alias(c))
        else:
            out.append(F.coalesce(F.col(f"n.{c}"), s).alias(c))
    return joined.select(*out)


def upsert_repos(stored: DataFrame, seen: DataFrame, now_ms: int) -> DataFrame:
    """Registers repositories by root path; a re-seen one is no longer missing."""
    merged = upsert(stored, seen, ["root_path"])
    back = seen.select("root_path", F.lit(True).alias("__seen")).distinct()
    return merged.join(back, "root_path", "left").select(
        *[
            F.when(F.col("__seen"), F.lit(False)).otherwise(F.col("missing")).alias("missing")
            if c == "missing"
            else F.when(F.col("__seen"), F.lit(now_ms)).otherwise(F.col("last_seen_ms")).alias(c)
            if c == "last_seen_ms"
            else F.col(c)
            for c in stored.columns
        ]
    )


def mark_missing(repos: DataFrame, gone: DataFrame) -> DataFrame:
    flag = gone.select("repo_id", F.lit(True).alias("__gone")).distinct()
    return repos.join(flag, "repo_id", "left").withColumn(
        "missing", F.coalesce("__gone", "missing")
    ).drop("__gone")


def subject_key() -> Column:
    return F.when(F.col("scope") == "patch", F.col("patch_id")).otherwise(
        F.concat_ws(
            ":", "session_id", F.coalesce("repo_id", F.lit("")), F.coalesce("rel_path", F.lit(""))
        )
    )


def upsert_outcomes(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """Latest computation per (scope, subject); ids come from the key, so they stay the same.

    Whole rows are compared by sorting. They are shuffled first, since few of them share a key: sorted
    before the shuffle, all that a task reads would lie in its memory at once.
    """
    both = stored.withColumn("__n", F.lit(0)).unionByName(
        computed.withColumn("__n", F.lit(1))
    ).withColumn("subject_key", subject_key()).repartition("scope", "subject_key")
    value = F.struct(*stored.columns)
    latest = both.groupBy("scope", "subject_key").agg(
        F.max_by(value, F.struct("computed_ms", "__n")).alias("row")
    )
    return latest.select(
        F.substring(F.sha2(F.concat_ws("|", "scope", "subject_key"), 256), 1, 26).alias("outcome_id"),
        "subject_key",
        "row.*",
    )


def prune(sessions: DataFrame, children: dict[str, DataFrame], before_ms: int) -> dict[str, DataFrame]:
    """Drops sessions last active before an instant and everything derived from them."""
    old = sessions.where(F.coalesce("ended_ms", "last_ms") < before_ms).select("session_id")
    kept = {"sessions": sessions.join(old, "session_id", "left_anti")}
    for name, frame in children.items():
        kept[name] = frame.join(old, "session_id", "left_anti")
    return kept


def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """name, n of each frame; each one is counted where it lies."""
    out = None
    for name, frame in frames.items():
        one = frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def delete_by_file(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of source files that are about to be read again."""
    return rows.join(files.select("file").distinct(), "file", "left_anti")


def resolve_repos(paths: DataFrame, repos: DataFrame, path: str = "path") -> DataFrame:
    """Nearest enclosing repository of each distinct path (null outside any).

    Each path explodes into its ancestor folders, which meet repository roots in an equi-join.
    """
    parts = F.split(F.col(path), "/")
    distinct = paths.select(path).distinct()
    ancestors = distinct.select(
        path,
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
                lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
            )
        ).alias("root_path"),
    )
    found = ancestors.join(repos.select("repo_id", "root_path"), "root_path").groupBy(path).agg(
        F.max_by(F.struct("repo_id", "root_path"), F.length("root_path")).alias("repo")
    )
    return distinct.join(found, path, "left").select(
        path, F.col("repo.repo_id").alias("repo_id"), F.col("repo.root_path").alias("root_path")
    )


def place_patches(patches: DataFrame, repos: DataFrame, session_repos: DataFrame) -> DataFrame:
    """Adds repo_id and rel_path; a path no repository encloses falls back to its session's."""
    from worklake.functions.paths import relative_to

    own = resolve_repos(patches, repos)
    fallback = session_repos.select("session_id", F.col("repo_root").alias("__root"))
    ids = repos.select(F.col("root_path").alias("__root"), F.col("repo_id").alias("__id"))
    joined = patches.join(own, "path", "left").join(fallback, "session_id", "left")
    joined = join_known(joined, ids, ["__root"])
    inside = F.when(F.col("root_path").isNotNull(), relative_to(F.col("root_path"), F.col("path")))
    via = relative_to(F.col("__root"), F.col("path"))
    rel = F.coalesce(inside, via)
    return joined.select(
        *patches.columns,
        F.when(rel.isNotNull(), F.coalesce("repo_id", "__id")).alias("repo_id"),
        rel.alias("rel_path"),
    )


def counted(df: DataFrame, **counters: Column) -> tuple[DataFrame, Observation]:
    """`df` whose counters are taken by the action that reads it, without a scan of their own."""
    seen = Observation()
    return df.observe(seen, *[c.alias(name) for name, c in counters.items()]), seen


def scan_report(spark: SparkSession, seen: list[Observation]) -> DataFrame:
    """name, n of what was counted; waits for the actions that count."""
    rows = [(name, n or 0) for one in seen for name, n in one.get.items()]
    return spark.createDataFrame(rows, "name string, n long")


class StreamCounters(StreamingQueryListener):
    """Totals of the counters that a stream's frames were given by `observe`, over all its batches."""

    def __init__(self):
        self.totals: dict[str, int] = {}

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        for row in event.progress.observedMetrics.values():
            for name, n in row.asDict().items():
                self.totals[name] = self.totals.get(name, 0) + (n or 0)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def duplicate_calls(patches: DataFrame) -> DataFrame:
    """Audit per provider: tool calls stored more than once, and across sessions."""
    per_call = patches.where("call_id is not null").groupBy("provider", "call_id", "path").agg(
        F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions")
    )
    return per_call.where("n > 1").groupBy("provider").agg(
        F.count("*").alias("calls"),
        F.sum("n").alias("rows"),
        F.count_if(F.col("sessions") > 1).alias("across_sessions"),
    )

"""What became of each edit: edit lines against commit lines, HEAD and the working tree.

Frames (all keyed by repo_id, rel_path, fp):
  lines     one row per subject line: subject columns, repo_id, rel_path, fp, ordinal, edit_ms
  hits      one row per added commit line: repo_id, rel_path, fp, sha, commit_ms, on_default
  snapshots distinct lines of current files: repo_id, rel_path, fp, kind in (head, worktree)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklake.config import DAY, OutcomeRules
from worklake.functions.text import fnv1a
from worklake.operators.ordered import fill_last, join_known, materialize, positions

KEY = ["repo_id", "rel_path", "fp"]
#: What one task holds of a line that is edited and committed all the time.
SPAN = 90 * DAY


def touched_only(hits: DataFrame, lines: DataFrame) -> DataFrame:
    """Commit lines of files that some edit touched (semi-join reduction before any shuffle of fps)."""
    return hits.join(lines.select("repo_id", "rel_path").distinct(), ["repo_id", "rel_path"], "left_semi")


def since_first_edit(hits: DataFrame, lines: DataFrame, margin_ms: int = DAY) -> DataFrame:
    """Commit lines not older than each repository's first edit minus a margin."""
    floor = lines.groupBy("repo_id").agg((F.min("edit_ms") - margin_ms).alias("__floor"))
    return hits.join(floor, "repo_id").where("commit_ms >= __floor").drop("__floor")


def line_index(hits: DataFrame) -> DataFrame:
    """One row per (repo, path, fp): first and last commit, last default-branch commit."""
    return hits.groupBy(*KEY).agg(
        F.min(F.struct("commit_ms", "sha")).alias("oldest"),
        F.max("commit_ms").alias("newest_ms"),
        F.max(F.when(F.col("on_default"), F.col("commit_ms"))).alias("newest_default_ms"),
    )


def match_commits(lines: DataFrame, hits: DataFrame, rules: OutcomeRules = OutcomeRules(), before: bool = True) -> DataFrame:
    """Adds committed, on_default, first_hit(commit_ms, sha) and, if asked for, before (control A) to each line.

    Lines and commit lines are written together once and walked backwards in time: what a line finds is
    the nearest commit at or after its cutoff, so no join multiplies rows however often a line was
    committed, and no line is looked up twice. Keys are cut into spans of time, so a hot one spreads.
    """
    end, none = F.col("__end"), F.lit(None)
    own = lines.select(
        *KEY, (F.col("edit_ms") - F.lit(rules.slack_ms)).alias("__at"), F.lit(0).alias("__end"),
        none.cast("string").alias("__sha"), none.cast("boolean").alias("__default"), F.struct(*lines.columns).alias("__line"),
    )
    known = hits.where(" and ".join(f"{c} is not null" for c in [*KEY, "commit_ms"])).select(
        *KEY, F.col("commit_ms").alias("__at"), F.lit(1).alias("__end"), F.col("sha").alias("__sha"), F.col("on_default").alias("__default")
    )
    rows = materialize(own.unionByName(known, allowMissingColumns=True), "lines-and-hits")
    hit = F.struct(F.col("__at").alias("commit_ms"), F.col("__sha").alias("sha"))
    found = fill_last(
        rows, KEY, F.floor(F.col("__at") / F.lit(SPAN)), ["__at", "__end", "__sha"],
        {"__hit": F.when(end == 1, hit), "__on": F.when((end == 1) & F.col("__default"), F.lit(True))}, descending=True,
    ).where("__end = 0")
    if before:
        oldest = rows.where("__end = 1").groupBy(*KEY).agg(F.min("__at").alias("__oldest"))
        found = found.join(oldest, KEY, "left")
    return found.select(
        "__line.*",
        F.col("__hit").isNotNull().alias("committed"),
        F.col("__on").isNotNull().alias("on_default"),
        *([F.coalesce(F.col("__oldest") < F.col("__at"), F.lit(False)).alias("before")] if before else []),
        F.col("__hit").alias("first_hit"),
    )


def match_snapshots(lines: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Adds in_tree and in_head: whether the line is present in the current files."""
    present = snapshots.groupBy(*KEY).agg(
        F.bool_or(F.col("kind") == "worktree").alias("in_tree"),
        F.bool_or(F.col("kind") == "head").alias("in_head"),
    )
    return lines.join(present, KEY, "left").fillna({"in_tree": False, "in_head": False})


def outcome_class(n, committed, in_tree, ignored, rules: OutcomeRules) -> Column:
    return (
        F.when(n == 0, "unknown")
        .when(committed / n >= rules.landed_share, "landed")
        .when(ignored, "unknown")
        .when(in_tree / n >= rules.tree_share, "uncommitted")
        .when((committed > 0) | (in_tree > 0), "partial")
        .otherwise("lost")
    )


def classify(
    subjects: DataFrame,
    lines: DataFrame,
    hits: DataFrame,
    snapshots: DataFrame,
    key: list[str],
    reverted: DataFrame | None = None,
    commits: DataFrame | None = None,
    rules: OutcomeRules = OutcomeRules(),
) -> DataFrame:
    """One outcome per subject.

    `subjects` holds the key columns, edit_ms and ignored; `lines` its distinct fingerprints.
    `reverted` is (repo_id, sha); `commits` adds (repo_id, sha, subject, branch) to the result.
    Subjects without lines come out as unknown/no-signal.
    """
    seen = match_snapshots(match_commits(lines, hits, rules, before=False), snapshots)
    share = lambda c: F.count_if(c)
    sums = seen.groupBy(*key).agg(
        F.count("*").alias("n"),
        share("committed").alias("c"),
        share("on_default").alias("d"),
        share("in_tree").alias("t"),
        share("in_head").alias("h"),
        F.min(
            F.when(
                F.col("first_hit").isNotNull(),
                F.struct("first_hit.commit_ms", "ordinal", "first_hit.sha"),
            )
        ).alias("first"),
    )
    joined = subjects.join(sums, key, "left").fillna({"n": 0, "c": 0, "d": 0, "t": 0, "h": 0})
    n = F.col("n")
    frac = lambda c: F.when(n > 0, F.col(c) / n).otherwise(F.lit(0.0))
    cls = outcome_class(n, F.col("c"), F.col("t"), F.coalesce("ignored", F.lit(False)), rules)
    judged = joined.withColumn("class", cls)
    known = F.col("class") != "unknown"
    landed = F.col("class") == "landed"
    judged = judged.select(
        *subjects.columns,
        "class",
        F.when(n == 0, "no-signal").when(~known, "gitignored").alias("unknown_reason"),
        F.when(known, frac("c")).otherwise(0.0).alias("frac_committed"),
        F.when(known, frac("d")).otherwise(0.0).alias("frac_on_default"),
        F.when(known, frac("t")).otherwise(0.0).alias("frac_in_tree"),
        frac("h").alias("frac_in_head"),
        F.when(landed, F.col("first.sha")).alias("first_sha"),
        F.when(landed, F.col("first.commit_ms")).alias("first_commit_ms"),
        F.when(
            landed, F.greatest(F.lit(0), F.col("first.commit_ms") - F.col("edit_ms")) / 1000
        ).alias("commit_lag_seconds"),
        n.alias("line_count"),
    )
    if reverted is None:
        judged = judged.withColumn("__reverted", F.lit(False))
    else:
        gone = reverted.select("repo_id", F.col("sha").alias("first_sha")).distinct()
        judged = join_known(judged, gone.withColumn("__reverted", F.lit(True)), ["repo_id", "first_sha"])
    judged = judged.withColumn("survival", survival(rules)).drop("__reverted", "frac_in_head")
    if commits is not None:
        named = commits.select("repo_id", F.col("sha").alias("first_sha"), "subject", "branch")
        judged = join_known(judged, named, ["repo_id", "first_sha"])
    return judged


def survival(rules: OutcomeRules) -> Column:
    return (
        F.when(F.col("class") != "landed", "unknown")
        .when(F.coalesce("__reverted", F.lit(False)), "reverted")
        .when(F.col("frac_in_head") >= rules.survival_share, "surviving")
        .when(F.col("frac_on_default") >= rules.survival_share, "churned")
        .otherwise("unknown")
    )


def net_session_file(patch_lines: DataFrame) -> DataFrame:
    """Lines a session added to a file and did not remove later.

    The last operation on a line decides; inside one patch removal comes before addition.
    """
    last = patch_lines.groupBy("session_id", *KEY).agg(
        F.max_by(
            F.struct("side", "ordinal"), F.struct("ts_ms", "patch_id", F.col("side") == "added")
        ).alias("op")
    )
    return last.where("op.side = 'added'").select(
        "session_id", *KEY, F.col("op.ordinal").alias("ordinal")
    )


def session_file_subjects(patches: DataFrame) -> DataFrame:
    """Each (session, repo, path), judged at its first edit."""
    return patches.groupBy("session_id", "repo_id", "rel_path").agg(F.min("ts_ms").alias("edit_ms"))


def other_file(files: DataFrame) -> DataFrame:
    """Control B: for each distinct (repo_id, rel_path) another file of its repo, picked by hash.

    One row per distinct file; single-file repositories get null.
    """
    ranked = positions(files.select("repo_id", "rel_path").distinct(), ["repo_id"], "rel_path", "pos")
    sizes = ranked.groupBy("repo_id").agg(F.count("*").alias("n"))
    placed = ranked.join(sizes, "repo_id").withColumn("start", fnv1a(F.col("rel_path")) % F.col("n"))
    # Landing on itself moves one on.
    placed = placed.withColumn(
        "want",
        F.when(F.col("start") == F.col("pos"), (F.col("start") + 1) % F.col("n")).otherwise(
            F.col("start")
        ),
    )
    target = ranked.select(
        "repo_id", F.col("pos").alias("want"), F.col("rel_path").alias("other_path")
    )
    return placed.where("n > 1").join(target, ["repo_id", "want"], "left").select(
        "repo_id", "rel_path", "other_path"
    )


def self_check(lines: DataFrame, hits: DataFrame, rules: OutcomeRules = OutcomeRules()) -> DataFrame:
    """Per repository: negative controls A and B, sample size and confidence.

    `lines` are patch-scope added lines (patch_id, repo_id, rel_path, fp, edit_ms).
    """
    cut = lines.withColumn("cutoff_ms", F.col("edit_ms") - F.lit(rules.slack_ms))
    index = line_index(hits)
    own = index.select(*KEY, F.col("oldest.commit_ms").alias("oldest_ms"))
    others = other_file(lines)
    elsewhere = index.select(
        "repo_id", F.col("rel_path").alias("other_path"), "fp", F.col("newest_ms").alias("other_ms")
    )
    flagged = (
        cut.join(own, KEY, "left")
        .join(others, ["repo_id", "rel_path"], "left")
        .join(elsewhere, ["repo_id", "other_path", "fp"], "left")
    )
    per_patch = flagged.groupBy("repo_id", "patch_id").agg(
        F.avg(F.coalesce(F.col("oldest_ms") < F.col("cutoff_ms"), F.lit(False)).cast("int")).alias("a"),
        F.avg(F.coalesce(F.col("other_ms") >= F.col("cutoff_ms"), F.lit(False)).cast("int")).alias("b"),
        F.max(F.col("other_path").isNotNull()).alias("has_other"),
    )
    hit = lambda c: F.avg((F.col(c) >= rules.landed_share).cast("int"))
    checks = per_patch.groupBy("repo_id").agg(
        hit("a").alias("control_a"),
        F.coalesce(
            F.avg(F.when(F.col("has_other"), (F.col("b") >= rules.landed_share).cast("int"))),
            F.lit(0.0),
        ).alias("control_b"),
        F.count("*").alias("sample"),
    )
    low = (F.col("sample") >= rules.control_min_sample) & (
        (F.col("control_a") > rules.control_a_max) | (F.col("control_b") > rules.control_b_max)
    )
    return checks.withColumn("confidence", F.when(low, "low").otherwise("normal"))


def unknown_outcomes(patches: DataFrame, repos: DataFrame) -> DataFrame:
    """Patches that cannot be judged: outside any repo, repo missing, or history unreadable.

    `repos` is (repo_id, missing, failed).
    """
    state = patches.join(repos, "repo_id", "left")
    reason = (
        F.when(F.col("repo_id").isNull() | F.col("rel_path").isNull(), "outside-repo")
        .when(F.col("missing"), "repo-missing")
        .when(F.col("failed"), "git-error")
    )
    return state.withColumn("unknown_reason", reason).where("unknown_reason is not null").withColumn(
        "class", F.lit("unknown")
    )


def input_keys(patches: DataFrame, refs: DataFrame, files: DataFrame, config: str) -> DataFrame:
    """Per repository, a hash of everything its outcomes depend on.

    Folded from per-row hashes with order-free sums, so no repository's rows are collected.
    """

    def fold(df: DataFrame, cols: list[str], name: str) -> DataFrame:
        h = F.xxhash64(*cols)
        return df.groupBy("repo_id").agg(
            F.concat_ws(
                ".",
                F.count("*").cast("string"),
                F.sum(h.cast("decimal(38,0)")).cast("string"),
                F.bit_xor(F.xxhash64(F.lit(name), *cols)).cast("string"),
            ).alias(name)
        )

    parts = (
        fold(patches, ["patch_id"], "p")
        .join(fold(refs, ["ref", "sha"], "r"), "repo_id", "left")
        .join(fold(files, ["rel_path", "size", "mtime_ms"], "f"), "repo_id", "left")
    )
    return parts.select(
        "repo_id",
        F.sha2(F.concat_ws("|", F.lit(config), "p", "r", "f"), 256).alias("input_key"),
    )


def changed_repos(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Repositories whose inputs differ from the last clean run."""
    return current.join(previous, ["repo_id", "input_key"], "left_anti")

"""Commit graph: reachability, default branch, working trunk, branch attribution, reverts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from worklake.config import TRUNK_SPAN_MS
from worklake.operators.ordered import fill_last, materialize

REVERT = r"This reverts commit ([0-9a-f]{7,40})"


@dataclass(frozen=True)
class History:
    """A reachability index: first-parent chains, and where one chain leads into another.

    `names` has one row a commit: id (a number), repo_id, sha. `commits` has id, chain (the id of the chain's
    oldest commit) and place (from there, 0). `crossings` are the parents outside a commit's own chain: chain,
    place, to_chain, to_place. Reaching a commit means reaching all lower places of its chain, so a set of
    reached commits is one highest place per chain.
    """

    names: DataFrame
    commits: DataFrame
    crossings: DataFrame


def _number(sha: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "repo_id", sha)


def _names(links: DataFrame, commits: DataFrame | None, seed: int = 0) -> tuple[DataFrame, int]:
    """(id, repo_id, sha, inside) of all commits, written, and the seed under which no two share an id."""
    known = F.lit(commits is None).alias("inside")
    ends = links.select("repo_id", "sha", known).unionByName(links.select("repo_id", F.col("parent_sha").alias("sha"), known))
    if commits is not None:
        ends = ends.unionByName(commits.select("repo_id", "sha", F.lit(True).alias("inside")))
    while True:
        numbered = ends.select(_number("sha", seed).alias("id"), "repo_id", "sha", "inside")
        names = materialize(numbered.groupBy("id", "repo_id", "sha").agg(F.bool_or("inside").alias("inside")), "names")
        if names.groupBy("id").count().where("count > 1").isEmpty():
            return names, seed
        seed += 1


def _jump(steps: DataFrame) -> DataFrame:
    """Each commit's pointer followed by that of where it points.

    A chain has one commit at each distance, so a row that none points to at this distance is not
    pointed to at a greater one either: only rows that were met are `kept` for the next jump.
    """
    asks = steps.where("not done").select(F.col("chain").alias("at"), "id", "place")
    below = steps.select(F.col("id").alias("at"), F.col("chain").alias("to"), F.col("place").alias("more"), "done")
    row = lambda c, chain, place, kept: F.struct(
        F.col(c).alias("id"), F.col(chain).alias("chain"), place.alias("place"), F.col("done").alias("done"), F.lit(kept).alias("kept")
    )
    moved, met = row("id", "to", F.col("place") + F.col("more"), False), row("at", "to", F.col("more"), True)
    return asks.join(below, "at").select(F.inline(F.when(F.col("done"), F.array(moved, met)).otherwise(F.array(moved))))


def history_index(parents: DataFrame, commits: DataFrame | None = None) -> History:
    """Index of (repo_id, sha, parent_sha, parent_no); written. With `commits`, of edges whose both ends are among them.

    Of a commit's first-parent children one goes on with its chain, the others start chains of their own.
    Commits are numbered once (ids are hashes, taken anew with another seed should two be equal), so that
    only numbers are shuffled after that. Chains and places come from pointer doubling: a chain takes part in
    as many rounds as the base-2 logarithm of its own length. All joins are on ids, so one giant repository
    spreads over all tasks.
    """
    links = materialize(
        parents.where("repo_id is not null and sha is not null and parent_sha is not null").select(
            "repo_id", "sha", "parent_sha", (F.col("parent_no") == 0).alias("first")
        ),
        "links",
    )
    names, seed = _names(links, commits)
    names = names.where("inside").drop("inside")
    edges = links.select(_number("sha", seed).alias("id"), _number("parent_sha", seed).alias("up"), "first")
    if commits is not None:
        inside = names.select("id")
        edges = edges.join(inside, "id", "left_semi").join(inside.withColumnRenamed("id", "up"), "up", "left_semi")
        edges = materialize(edges, "edges")
    heirs = edges.where("first").groupBy("up").agg(F.min("id").alias("id")).select("id", "up")
    ends = names.select("id", F.lit(None).cast("long").alias("up")).unionByName(heirs).groupBy("id").agg(F.min("up").alias("up"))
    last = F.col("up").isNull()
    steps = ends.select(
        "id", F.coalesce("up", "id").alias("chain"), F.when(last, 0).otherwise(1).cast("long").alias("place"),
        last.alias("done"), F.lit(False).alias("kept"),
    )
    steps = materialize(steps, "chains")
    placed = None  # those that point to the oldest of their chain
    while True:
        done = steps.where("done and not kept").select("id", "chain", "place")
        placed = done if placed is None else placed.unionByName(done)
        if steps.where("not done").isEmpty():
            break
        steps = materialize(_jump(steps), "chains")
    to = placed.select(F.col("id").alias("up"), F.col("chain").alias("to_chain"), F.col("place").alias("to_place"))
    crossings = edges.select("id", "up").join(placed, "id").join(to, "up").where("chain <> to_chain")
    return History(names, placed, materialize(crossings.select("chain", "place", "to_chain", "to_place").distinct(), "crossings"))


def _stairs(reached: DataFrame) -> DataFrame:
    """Per chain the labels that are the smallest at some place: the smaller a label, the lower it ends."""
    best = reached.repartition("chain").groupBy("chain", "label").agg(F.max("place").alias("place"), F.max("was").alias("was"))
    smaller = Window.partitionBy("chain").orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.max("place").over(smaller)
    return best.withColumn("__covered", covered).where("__covered is null or place > __covered").drop("__covered")


#: Steps of a walk that are read one by one before they are written as one.
KEPT_STEPS = 8


def reach(seeds: DataFrame, index: History) -> DataFrame:
    """(chain, label, place): up to which place of which chain each seed's label gets; written.

    `seeds` are (id, label). A label that no commit would have as its smallest is dropped, as it can't be
    the smallest of their ancestors either. Rounds are as many as merges are nested. A round looks only at
    what the one before has added, and compares it with what is known of the chains it leads to.
    """
    plain, new = ["chain", "label", "place"], F.lit(-1).cast("long").alias("was")
    again = F.col("place").alias("was")
    news = materialize(_stairs(seeds.join(index.commits, "id").select(*plain, new)), "reached")
    crossings = index.crossings.withColumnRenamed("place", "__at")
    known, steps = news.select(*plain), 1
    while not news.isEmpty():
        crossed = news.join(crossings, "chain").where("__at <= place and __at > was")
        crossed = crossed.select(F.col("to_chain").alias("chain"), "label", F.col("to_place").alias("place"))
        crossed = materialize(crossed.groupBy("chain", "label").agg(F.max("place").alias("place")), "crossed")
        touched = known.join(crossed.select("chain"), "chain", "left_semi")
        news = materialize(_stairs(touched.select(*plain, again).unionByName(crossed.select(*plain, new))).where("was < place"), "reached")
        known, steps = known.unionByName(news.select(*plain)), steps + 1
        if steps == KEPT_STEPS:
            known, steps = materialize(_stairs(known.select(*plain, again)).select(*plain), "reached"), 1
    return materialize(_stairs(known.select(*plain, again)).select(*plain), "reached")


def labels_of(reached: DataFrame, index: History) -> DataFrame:
    """(id, label) of every commit that is reached: the label that ends at the nearest place above."""
    nothing = F.lit(None)
    both = index.commits.select("chain", "place", F.lit(0).alias("__end"), "id", nothing.cast("string").alias("label")).unionByName(
        reached.select("chain", "place", F.lit(1).alias("__end"), nothing.cast("long").alias("id"), "label")
    )
    bucket = F.floor(F.col("place") / F.lit(65_536))
    found = fill_last(both, ["chain"], bucket, ["place", "__end"], {"found": F.col("label")}, descending=True)
    return found.where("__end = 0 and found is not null").select("id", F.col("found").alias("label"))


def _known(seeds: DataFrame, index: History) -> tuple[DataFrame, DataFrame]:
    """Seeds (repo_id, sha, label) as (id, label), and those without any parent or child; both written."""
    seeds = materialize(seeds.select("repo_id", "sha", "label"), "seeds")
    found = materialize(seeds.join(index.names, ["repo_id", "sha"]), "seeds")
    alone = seeds.join(found.select("repo_id", "sha"), ["repo_id", "sha"], "left_anti")
    return found.select("id", "label"), alone.groupBy("repo_id", "sha").agg(F.min("label").alias("label"))


def _named(found: DataFrame, index: History) -> DataFrame:
    return found.join(index.names, "id").select("repo_id", "sha", "label")


def propagate_labels(seeds: DataFrame, parents: DataFrame, index: History | None = None) -> DataFrame:
    """Smallest seed label that reaches each commit: (repo_id, sha, label).

    `seeds` are (repo_id, sha, label); `parents` (repo_id, sha, parent_sha, parent_no).
    """
    index = index or history_index(parents)
    within, alone = _known(seeds, index)
    return _named(labels_of(reach(within, index), index), index).unionByName(alone)


def default_branch(refs: DataFrame) -> DataFrame:
    """Per repository: the remote's HEAD, else main, else master, else the checked-out branch.

    `refs` are (repo_id, ref, sha, target); symbolic refs name their target.
    """
    ref = F.col("ref")
    priority = (
        F.when(ref == "refs/remotes/origin/HEAD", 0)
        .when(ref == "refs/heads/main", 1)
        .when(ref == "refs/heads/master", 2)
        .when((ref == "HEAD") & F.col("target").isNotNull(), 3)
    )
    name = F.when(
        F.col("target").isNotNull(), F.regexp_replace("target", "^refs/(heads|remotes)/", "")
    ).otherwise(F.regexp_replace(ref, "^refs/heads/", ""))
    ranked = refs.select("repo_id", priority.alias("p"), name.alias("name")).where("p is not null")
    return ranked.groupBy("repo_id").agg(F.min_by("name", "p").alias("default_branch"))


def default_tips(refs: DataFrame, defaults: DataFrame) -> DataFrame:
    """Tips of the default branch: the remote one and its local twin both count."""
    short = F.regexp_replace("ref", "^refs/(heads|remotes)/", "")
    named = refs.where("target is null").select("repo_id", short.alias("name"), "ref", "sha")
    d = F.col("default_branch")
    twin = F.regexp_replace(d, "^origin/", "")
    return named.join(defaults, "repo_id").where(
        (F.col("name") == d) | ((F.col("ref") == F.concat(F.lit("refs/heads/"), twin)))
    ).select("repo_id", "sha")


def on_default(refs: DataFrame, parents: DataFrame, index: History | None = None) -> DataFrame:
    """Commits reachable from the default branch."""
    tips = default_tips(refs, default_branch(refs)).withColumn("label", F.lit("default"))
    return propagate_labels(tips, parents, index).select("repo_id", "sha")


def working_trunk(refs: DataFrame, parents: DataFrame, commits: DataFrame, index: History | None = None) -> DataFrame:
    """Checked-out branch that contains the default tip and has run ahead for over 14 days."""
    defaults = default_branch(refs)
    head = refs.where("ref = 'HEAD' and target is not null").select(
        "repo_id", F.regexp_replace("target", "^refs/heads/", "").alias("head"), "sha"
    )
    other = head.join(defaults, "repo_id").where(
        "head <> default_branch and head <> regexp_replace(default_branch, '^origin/', '')"
    )
    index = index or history_index(parents)
    heads, lone_heads = _known(other.select("repo_id", "sha", F.lit("head").alias("label")), index)
    tips = default_tips(refs, defaults).distinct()
    ends, lone_ends = _known(tips.withColumn("label", F.lit("default")), index)
    # A tip is reached where the head gets as far in its chain; one without history only by itself.
    ahead = reach(heads, index).select("chain", F.col("place").alias("__upto"))
    at = ends.join(index.commits, "id").join(ahead, "chain", "left").select("id", F.coalesce(F.col("place") <= F.col("__upto"), F.lit(False)).alias("__in"))
    lone = lone_ends.join(lone_heads.select("repo_id", "sha", F.lit(True).alias("__in")), ["repo_id", "sha"], "left").select("repo_id", "__in")
    contains = (
        at.join(index.names, "id").select("repo_id", "__in").unionByName(lone)
        .groupBy("repo_id")
        .agg(F.bool_and(F.coalesce("__in", F.lit(False))).alias("contains_default"))
    )
    # The smaller label wins where both get, which leaves the head what the default branch lacks.
    both = labels_of(reach(heads.unionByName(ends), index), index).where("label = 'head'")
    alone = lone_heads.join(lone_ends, ["repo_id", "sha"], "left_anti")
    mine = materialize(_named(both, index).unionByName(alone).select("repo_id", "sha"), "own")
    own = (
        commits.select("repo_id", "sha", "commit_ms").join(mine, ["repo_id", "sha"])
        .groupBy("repo_id")
        .agg((F.max("commit_ms") - F.min("commit_ms")).alias("span_ms"))
    )
    return (
        other.join(contains, "repo_id")
        .join(own, "repo_id")
        .where(F.col("contains_default") & (F.col("span_ms") > TRUNK_SPAN_MS))
        .select("repo_id", F.col("head").alias("working_trunk"))
    )


def branch_of(refs: DataFrame, parents: DataFrame, default_commits: DataFrame | None = None, index: History | None = None) -> DataFrame:
    """A branch for each commit off the default branch (`default_commits`, worked out if not given): the first by name that reaches it.

    What such a commit is reached through is off the default branch as well, so the whole history's
    index serves.
    """
    index = index or history_index(parents)
    name = F.regexp_replace("ref", "^refs/(heads|remotes/[^/]+)/", "")
    tips = refs.where("target is null and ref rlike '^refs/(heads|remotes)/'").select(
        "repo_id", "sha", name.alias("label")
    )
    within, alone = _known(tips, index)
    if default_commits is None:
        ends, lone = _known(default_tips(refs, default_branch(refs)).withColumn("label", F.lit("default")), index)
        default = labels_of(reach(ends, index), index).select("id")
    else:
        lone = default_commits.select("repo_id", "sha")
        default = lone.join(index.names, ["repo_id", "sha"]).select("id")
    default = materialize(default, "default-ids")
    found = labels_of(reach(within.join(default, "id", "left_anti"), index), index).join(default, "id", "left_anti")
    return (
        _named(found, index).unionByName(alone.join(lone.select("repo_id", "sha"), ["repo_id", "sha"], "left_anti"))
        .withColumnRenamed("label", "branch")
    )


def reverted_commits(commits: DataFrame) -> DataFrame:
    """Commits that some later message reverts; abbreviated ids match every commit they prefix."""
    cited = commits.select(
        "repo_id", F.explode(F.regexp_extract_all("body", F.lit(REVERT), F.lit(1))).alias("cited")
    ).distinct()
    known = commits.select("repo_id", "sha", F.substring("sha", 1, 7).alias("head"))
    return (
        cited.withColumn("head", F.substring("cited", 1, 7))
        .join(known, ["repo_id", "head"])
        .where(F.col("sha").startswith(F.col("cited")))
        .select("repo_id", "sha")
        .distinct()
    )

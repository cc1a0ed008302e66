"""Search over thread fields and the leak audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Searched fields in priority order with their weights.
FIELDS = (("title", 3), ("branch", 3), ("commit", 2), ("file", 2), ("failure", 1))


def thread_fields(
    threads: DataFrame, members: DataFrame, sessions: DataFrame, outcomes: DataFrame, failures: DataFrame
) -> DataFrame:
    """(thread_id, field, text) of everything a search looks at."""
    m = members.select("session_id", "thread_id")
    s = sessions.drop("thread_id").join(m, "session_id")
    o = outcomes.join(m, "session_id")
    f = failures.join(m, "session_id")
    parts = [
        threads.select("thread_id", F.lit("title").alias("field"), F.col("title").alias("text")),
        s.select("thread_id", F.lit("title").alias("field"), F.col("title").alias("text")),
        threads.select("thread_id", F.lit("branch").alias("field"), F.col("branch").alias("text")),
        s.select(
            "thread_id", F.lit("branch").alias("field"),
            F.coalesce("git_branch_end", "git_branch_start").alias("text"),
        ),
        o.select("thread_id", F.lit("commit").alias("field"), F.col("first_subject").alias("text")),
        o.select("thread_id", F.lit("file").alias("field"), F.col("rel_path").alias("text")),
        f.select("thread_id", F.lit("failure").alias("field"), F.col("signature").alias("text")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("text is not null and text <> ''")


def search_threads(fields: DataFrame, terms: list[str]) -> DataFrame:
    """Per thread: terms matched and score; a term scores the first field (by priority) it is in.

    Terms come from one query, so they are a handful of literals: one pass over the texts, one
    map-side combined aggregate per thread.
    """
    rank = {name: i for i, (name, _) in enumerate(FIELDS)}
    place = F.create_map(*[x for n, i in rank.items() for x in (F.lit(n), F.lit(i))])
    text = F.lower("text")
    hits = [
        F.min(F.when(F.contains(text, F.lit(t)), place[F.col("field")])).alias(f"t{i}")
        for i, t in enumerate(terms)
    ]
    found = fields.groupBy("thread_id").agg(*hits)
    weight = F.create_map(*[x for i, (_, w) in enumerate(FIELDS) for x in (F.lit(i), F.lit(w))])
    cols = [F.col(f"t{i}") for i in range(len(terms))]
    needed = max(1, -(-len(terms) // 2))
    names = F.create_map(*[x for n, i in rank.items() for x in (F.lit(i), F.lit(n))])
    matched = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    score = sum((F.coalesce(weight[c], F.lit(0)) for c in cols), F.lit(0))
    on = F.array_sort(F.array_distinct(F.array_compact(F.array(*[names[c] for c in cols]))))
    return found.select(
        "thread_id", matched.alias("matched"), score.alias("score"), on.alias("matched_on")
    ).where(F.col("matched") >= needed)


def verdict(landed, uncommitted, partial, lost) -> Column:
    # Result sentences.
    nothing = (landed == 0) & (uncommitted == 0) & (partial == 0) & (lost == 0)
    return (
        F.when(nothing, "No file edits recorded")
        .when((landed > 0) & (lost == 0) & (uncommitted == 0) & (partial == 0), "Landed")
        .when(landed > 0, "Partly landed")
        .when((uncommitted > 0) | (partial > 0), "Left uncommitted")
        .otherwise("Did not land: the edits are in neither git history nor the working tree")
    )


def prose_snippets(texts: DataFrame, text: str, keep: list[str], length: int | None = None) -> DataFrame:
    """Texts that are prose: at least 24 characters and three words; their first `length` characters, if given."""
    snippet = F.col(text) if length is None else F.substring(text, 1, length)
    words = F.size(F.filter(F.split(F.trim(snippet), r"\s+"), lambda w: w != ""))
    return texts.select(*keep, snippet.alias("snippet")).where(
        (F.length("snippet") >= 24) & (words >= 3)
    )


def find_snippets(snippets: DataFrame, stored: DataFrame, text: str, key: str, gram: int = 12, head: int = 24) -> DataFrame:
    """All (snippet, stored row) containments of snippets of any length but 0.

    Candidates come from an equi-join on character grams of the snippets' heads, `head` characters or as
    few as the shortest snippet has. A head covers a whole gram at some multiple of the stride, wherever
    it starts in a text. So the texts give one gram per stride, the heads all of theirs, and each text
    cell carries enough characters around its gram to check the head. Snippets that go on behind their
    head are then sought whole in the texts that hold it.
    """
    snippets = snippets.where(F.length("snippet") > 0)
    least = snippets.agg(F.min(F.length("snippet"))).first()[0]
    shortest = min(head, least or head)
    gram, columns = min(gram, shortest), snippets.columns
    snippets = snippets.withColumn("__head", F.substring("snippet", 1, shortest))
    longest = shortest
    stride = shortest - gram + 1
    reach = longest - gram
    # Pieces first: taking a substring scans the string up to it, so cells are cut from short ones.
    piece = 80 * stride
    pieces = stored.where(F.length(text) >= gram).select(
        key,
        text,
        F.explode(F.sequence(F.lit(0), F.length(text) - gram, F.lit(piece))).alias("base"),
    )
    lead = F.least(F.col("base"), F.lit(reach))
    pieces = pieces.select(
        key,
        lead.alias("lead"),
        F.col(text).substr(F.col("base") - lead + 1, lead + piece + gram + reach).alias("part"),
    )
    inside = F.least(F.lit(piece - stride), F.length("part") - F.col("lead") - gram)
    cells = pieces.select(
        key, "part", F.explode(F.sequence(F.col("lead"), F.col("lead") + inside, F.lit(stride))).alias("at")
    )
    start = F.greatest(F.col("at") - reach, F.lit(0))
    cells = cells.select(
        key,
        F.col("part").substr(F.col("at") + 1, F.lit(gram)).alias("gram"),
        F.col("part").substr(start + 1, F.lit(gram + 2 * reach)).alias("around"),
        (F.col("at") - start).alias("before"),
    )
    grams = snippets.select(
        "*", F.explode(F.sequence(F.lit(0), F.length("__head") - gram)).alias("offset")
    ).withColumn("gram", F.col("__head").substr(F.col("offset") + 1, F.lit(gram)))
    begins = F.col("before") - F.col("offset")
    held = (
        cells.join(grams, "gram")
        .where(begins >= 0)
        .where(F.col("around").substr(begins + 1, F.length("__head")) == F.col("__head"))
        .select(*columns, key)
        .distinct()
    )
    more = F.length("snippet") > shortest
    whole = held.where(more).join(stored.select(key, text), key).where(F.contains(text, "snippet"))
    return held.where(~more).unionByName(whole.select(*columns, key)).distinct()

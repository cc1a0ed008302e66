"""Small fixtures of the history operators."""

import random

from worklake.operators import history as G


def test_default_branch_falls_back(spark):
    refs = spark.createDataFrame(
        [
            ("a", "refs/remotes/origin/HEAD", "1", "refs/remotes/origin/trunk"), ("a", "refs/heads/main", "1", None),
            ("b", "refs/heads/main", "1", None), ("b", "refs/heads/master", "1", None), ("c", "refs/heads/master", "1", None),
            ("c", "HEAD", "1", "refs/heads/x"), ("d", "HEAD", "1", "refs/heads/feat/x"), ("d", "refs/heads/feat/x", "1", None), ("e", "HEAD", "1", None),
        ],
        "repo_id string, ref string, sha string, target string",
    )
    got = {r.repo_id: r.default_branch for r in G.default_branch(refs).collect()}
    assert got == {"a": "origin/trunk", "b": "main", "c": "master", "d": "feat/x"}


PARENTS = "repo_id string, sha string, parent_sha string, parent_no int"


def test_index_shuffles_numbers_and_drops_short_chains(spark, monkeypatch):
    """Commits are numbered once; chains that are done are not looked up again for the sake of a long one."""
    parents = [("a", f"l{i}", f"l{i - 1}", 0) for i in range(1, 65)]
    parents += [("a", f"s{k}-{i}", f"s{k}-{i - 1}", 0) for k in range(300) for i in range(1, 4)]
    parents += [("a", "l64", "s7-3", 1), ("a", "l64", "s7-3", 1)]
    written, write = [], G.materialize

    def count(df, name="step"):
        kept = write(df, name)
        written.append((name, kept.count()))
        return kept

    monkeypatch.setattr(G, "materialize", count)
    index = G.history_index(spark.createDataFrame(parents, PARENTS))
    chains = [n for name, n in written if name == "chains"]
    assert chains[0] == 65 + 4 * 300 and max(chains[4:]) <= 2 * 65
    assert {t for _, t in index.commits.dtypes + index.crossings.dtypes} == {"bigint"}
    place = {r.sha: r.place for r in index.commits.join(index.names, "id").collect()}
    assert place == {**{f"l{i}": i for i in range(65)}, **{f"s{k}-{i}": i for k in range(300) for i in range(4)}}
    assert [(r.place, r.to_place) for r in index.crossings.collect()] == [(64, 3)]


def test_reached_within_floor_trunk_and_branches(spark):
    """Against walks over the edges: floored history, branches off the default one, a head ahead of it, lone tips."""
    rng = random.Random(5)
    up = {("a", i): sorted({i - 1 if rng.random() < 0.6 else rng.randrange(i), rng.randrange(i) if rng.random() < 0.3 else i - 1}) for i in range(1, 120)}
    parents = [(r, str(i), str(p), no) for (r, i), ps in up.items() for no, p in enumerate(ps)]
    refs = [("a", "refs/heads/main", "100", None), ("a", "refs/heads/x", "119", None), ("a", "refs/heads/b", "117", None), ("a", "HEAD", "119", "refs/heads/x"),
            ("z", "refs/heads/main", "lone", None), ("z", "refs/heads/y", "other", None)]
    refs = spark.createDataFrame(refs, "repo_id string, ref string, sha string, target string")
    edges = spark.createDataFrame(parents, PARENTS)
    commits = spark.createDataFrame([("a", str(i), i * 86_400_000) for i in range(120) if i % 9], "repo_id string, sha string, commit_ms long")

    def walk(tip, ok):
        todo, seen = [tip], set()
        while todo:
            c = todo.pop()
            if c not in seen:
                seen.add(c)
                todo += [p for p in up.get(("a", c), []) if ok(c) and ok(p)]
        return seen

    inside, anywhere = (lambda c: c % 9 > 0), (lambda c: True)
    got = G.on_default(refs, edges, G.history_index(edges, commits)).collect()
    assert sorted((r.repo_id, r.sha) for r in got) == sorted([("z", "lone")] + [("a", str(c)) for c in walk(100, inside)])
    main = walk(100, anywhere)
    want = {("a", str(c)): "x" for c in walk(119, anywhere) - main} | {("a", str(c)): "b" for c in walk(117, anywhere) - main} | {("z", "other"): "y"}
    index = G.history_index(edges)
    for default in (None, G.on_default(refs, edges, index)):
        assert {(r.repo_id, r.sha): r.branch for r in G.branch_of(refs, edges, default, index).collect()} == want
    days = [c for c in walk(119, anywhere) - main if c % 9]
    trunk = [("a", "x")] if 100 in walk(119, anywhere) and max(days) - min(days) > 14 else []
    assert [tuple(r) for r in G.working_trunk(refs, edges, commits, index).collect()] == trunk

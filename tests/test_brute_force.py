"""Threads, collisions and reachability against direct row-by-row implementations."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from worklake.config import DAY, HOUR, MINUTE, LoopRules, ThreadRules
from worklake.operators import collisions as C
from worklake.operators import history as G
from worklake.operators import threads as T


def world(seed, n, hot=0.4, days=40, fps=60):
    """Sessions with branches, parents and patches; one repository, branch and file are hot."""
    rng = random.Random(seed)
    sessions, patches, lines = [], [], []
    for i in range(n):
        start = rng.randrange(days * 24) * HOUR + rng.choice([0, 0, 7])
        repo = "hot" if rng.random() < hot else f"r{rng.randrange(4)}"
        branch = "wip" if rng.random() < 0.15 else rng.choice([None, None, None, "main", "HEAD", f"feat/{rng.randrange(30)}"])
        parent = f"s{rng.randrange(n):03d}" if rng.random() < 0.1 else None
        sid = f"s{i:03d}"
        sessions.append((sid, "codex", parent, None if rng.random() < 0.03 else repo, start, start + rng.randrange(30) * HOUR, branch, None))
        for p in range(rng.randrange(3)):
            path = "hot.ts" if rng.random() < 0.4 else f"f{rng.randrange(12)}.ts"
            pid, ts = f"{sid}-{p}", start + rng.randrange(200) * MINUTE
            patches.append((pid, sid, repo, path, ts))
            for fp in {rng.randrange(fps) for _ in range(rng.randrange(3))}:
                lines.append((pid, sid, repo, path, ts, rng.choice(["added", "added", "removed"]), f"x{fp}"))
    return sessions, patches, lines


SESSION = "session_id string, provider string, parent_session_id string, repo_id string, started_ms long, last_ms long, git_branch_start string, git_branch_end string"
PATCH = "patch_id string, session_id string, repo_id string, rel_path string, ts_ms long"
LINE = PATCH + ", side string, fp string"


def greedy(sessions, patches, lines, rules):
    """The thread rule, one session after the other."""
    by_id = {s[0]: s for s in sessions}
    repo = lambda s: s[3] or (by_id[s[2]][3] if s[2] in by_id else None)
    order = sorted((s for s in sessions if repo(s)), key=lambda s: s[0], reverse=True)
    order.sort(key=lambda s: s[4])
    span = {}
    for s in order:
        for b in (s[6], s[7]):
            if b:
                lo, hi = span.get((repo(s), b), (s[4], s[5]))
                span[repo(s), b] = (min(lo, s[4]), max(hi, s[5]))

    def work(s):
        return {
            b for b in (s[6], s[7])
            if b and b not in ("HEAD", "main") and span[repo(s), b][1] - span[repo(s), b][0] <= rules.trunk_span_ms
        }

    files, added, removed = {}, {}, {}
    for p in patches:
        files.setdefault(p[1], set()).add(p[3])
    for l in lines:
        (added if l[5] == "added" else removed).setdefault(l[1], set()).add(l[6])
    root, pred, done = {}, {}, []
    for s in order:
        sid = s[0]
        root[sid], pred[sid] = sid, None
        if s[2] in root and s[2] != sid:
            pred[sid], root[sid] = s[2], root[s[2]]
        else:
            for c in reversed(done):
                if repo(c) != repo(s) or s[4] - c[5] > rules.max_gap_ms:
                    continue
                if s[4] - by_id[root[c[0]]][4] > rules.max_span_ms:
                    continue
                a, b = files.get(sid, set()), files.get(c[0], set())
                if work(s) & work(c) or (
                    a and b and (removed.get(sid, set()) & added.get(c[0], set()) or len(a & b) / len(a | b) >= rules.min_jaccard)
                ):
                    pred[sid], root[sid] = c[0], root[c[0]]
                    break
        done.append(s)
    return {k: (pred[k], root[k]) for k in root}


@pytest.mark.parametrize("seed,n,days", [(1, 160, 40), (2, 160, 12)])
def test_threads_equal_the_greedy_rule(spark, seed, n, days):
    sessions, patches, lines = world(seed, n, days=days)
    rules = ThreadRules(max_span_ms=4 * DAY)
    got = T.link_sessions(
        spark.createDataFrame(sessions, SESSION),
        spark.createDataFrame(patches, PATCH),
        spark.createDataFrame(lines, LINE),
        spark.createDataFrame([("hot", "origin/main"), ("r1", "main")], "repo_id string, default_branch string").unionByName(
            spark.createDataFrame([(f"r{i}", "main") for i in (0, 2, 3)], "repo_id string, default_branch string")
        ),
        rules,
        batch=2,
    )
    want = greedy(sessions, patches, lines, rules)
    assert {r["session_id"]: (r["pred"], r["root"]) for r in got.collect()} == want
    assert any(p is not None for p, _ in want.values())


def test_long_work_takes_few_steps(spark, monkeypatch):
    """A session a day for months on one file, some continued from elsewhere: threads follow each other, steps do not add up."""
    sessions = [(f"s{i:03d}", "codex", None, "r0", i * DAY, i * DAY + HOUR, None, None) for i in range(120)]
    sessions += [(f"t{i:03d}", "codex", f"s{i * 7:03d}", "r2", i * 7 * DAY + 5 * HOUR, i * 7 * DAY + 6 * HOUR, None, None) for i in range(17)]
    sessions += [(f"u{i:03d}", "codex", None, "r2", i * 7 * DAY + 9 * HOUR, i * 7 * DAY + 9 * HOUR, None, None) for i in range(17)]
    patches = [(f"{s[0]}-0", s[0], s[3], "a.ts", s[4]) for s in sessions]
    steps, write = [], T.materialize
    monkeypatch.setattr(T, "materialize", lambda df, name="step": steps.append(name) or write(df, name))
    got = T.link_sessions(
        spark.createDataFrame(sessions, SESSION), spark.createDataFrame(patches, PATCH), spark.createDataFrame([], LINE),
        spark.createDataFrame([("r0", "main"), ("r2", "main")], "repo_id string, default_branch string"),
    )
    want = greedy(sessions, patches, [], ThreadRules())
    assert {r["session_id"]: (r["pred"], r["root"]) for r in got.collect()} == want
    assert len({root for _, root in want.values()}) > 14 and len(steps) < 40


def test_threads_write_a_row_a_session(spark, monkeypatch):
    """Many sessions at once on few files and lines: no links, offers or needs are written, no step has more rows than sessions."""
    sessions, patches, lines = world(5, 150, hot=0.9, days=3, fps=20)
    written, write = [], T.materialize

    def counted(df, name="step"):
        out = write(df, name)
        written.append((out.count(), name))
        return out

    monkeypatch.setattr(T, "materialize", counted)
    got = T.link_sessions(
        spark.createDataFrame(sessions, SESSION), spark.createDataFrame(patches, PATCH), spark.createDataFrame(lines, LINE),
        spark.createDataFrame([(f"r{i}", "main") for i in range(4)] + [("hot", "main")], "repo_id string, default_branch string"),
    )
    assert {r["session_id"]: (r["pred"], r["root"]) for r in got.collect()} == greedy(sessions, patches, lines, ThreadRules())
    assert max(written)[0] <= len(sessions)


def evidence(forest, sessions, patches, lines):
    """Why sessions joined, pair by pair; session branches as in `world`, whose trunk-like ones are `wip` and main."""
    by_id = {s[0]: s for s in sessions}
    files, added, removed = {}, {}, {}
    for p in patches:
        files.setdefault(p[1], set()).add(p[3])
    for l in lines:
        (added if l[5] == "added" else removed).setdefault(l[1], set()).add(l[6])
    out = set()
    for sid, (pred, _) in forest.items():
        if pred is None:
            continue
        a, b = files.get(sid, set()), files.get(pred, set())
        over, branch = len(removed.get(sid, set()) & added.get(pred, set())), by_id[sid][6]
        if by_id[sid][2] == pred:
            out.add((pred, sid, "continuation", None, None, None, None))
        elif branch == by_id[pred][6] and (branch or "").startswith("feat/"):
            out.add((pred, sid, "same-branch", branch, None, None, None))
        elif over:
            out.add((pred, sid, "line-overlap", None, over, None, None))
        else:
            out.add((pred, sid, "file-overlap", None, None, round(len(a & b) / len(a | b), 2), len(a & b)))
    return out


def test_evidence_is_seen_while_linking(spark):
    """The walk says what a session and its pred have in common: no files or lines are joined again, and joins would find the same."""
    sessions, patches, lines = world(7, 160, days=12)
    sessions = [s if s[6] != "wip" else (*s[:6], None, None) for s in sessions]
    sessions = [(*s[:6], "feat/3", None) if i % 6 == 0 else s for i, s in enumerate(sessions)]
    frames = [
        spark.createDataFrame(sessions, SESSION), spark.createDataFrame(patches, PATCH), spark.createDataFrame(lines, LINE),
        spark.createDataFrame([(f"r{i}", "main") for i in range(4)] + [("hot", "main")], "repo_id string, default_branch string"),
    ]
    forest = T.materialize(T.link_sessions(*frames, ThreadRules()))
    found = T.link_evidence(forest, *frames)
    want = evidence(greedy(sessions, patches, lines, ThreadRules()), sessions, patches, lines)
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    assert {r[2] for r in want} == {"continuation", "same-branch", "line-overlap", "file-overlap"}
    assert {tuple(r) for r in T.link_evidence(forest.select("session_id", "pred"), *frames).collect()} == want
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 2


def all_pairs(sessions, patches, lines, landed, rules):
    """The collision rule over every pair of patches of a file."""
    parent = {s[0]: s[2] for s in sessions}
    span = {s[0]: (s[4], s[5]) for s in sessions}
    fps = {}
    for l in lines:
        fps.setdefault((l[0], l[5]), set()).add(l[6])
    found = {}
    ordered = sorted(patches, key=lambda p: (p[4], p[0]))
    for j, b in enumerate(ordered):
        for a in reversed(ordered[:j]):
            if (a[2], a[3]) != (b[2], b[3]) or b[4] - a[4] > rules.overwrite_ms:
                continue
            x, y = a[1], b[1]
            if x == y or parent.get(x) == y or parent.get(y) == x or (parent.get(x) and parent.get(x) == parent.get(y)):
                continue
            n = len(fps.get((a[0], "added"), set()) & fps.get((b[0], "removed"), set()))
            over = n > 0 and (x, a[3]) not in landed
            meet = span[x][0] <= span[y][1] and span[y][0] <= span[x][1]
            if not over and not (b[4] - a[4] <= rules.concurrent_ms and meet):
                continue
            key = ("overwrite" if over else "concurrent-edit", a[2], a[3], x, y)
            if key in found:
                found[key][0] = min(found[key][0], a[4])
            else:
                found[key] = [a[4], b[4], n if over else None, None if over else int((b[4] - a[4]) / MINUTE + 0.5)]
    return {
        k: tuple(v) for k, v in found.items() if k[0] == "overwrite" or ("overwrite", *k[1:]) not in found
    }


@pytest.mark.parametrize("seed", [4, 5])
def test_collisions_equal_all_pairs(spark, seed):
    sessions, patches, lines = world(seed, 120, hot=0.6, days=6, fps=8)
    landed = {(p[1], p[3]) for p in patches if p[1].endswith("3")}
    rules = LoopRules(overwrite_ms=2 * DAY)
    got = C.detect_collisions(
        spark.createDataFrame(patches, PATCH),
        spark.createDataFrame(lines, LINE),
        spark.createDataFrame(sessions, SESSION),
        spark.createDataFrame(list(landed), "session_id string, rel_path string"),
        rules,
    ).collect()
    found = {
        (r["kind"], r["repo_id"], r["rel_path"], r["session_a"], r["session_b"]): (
            r["start_ms"], r["end_ms"], r["overwritten_lines"], r["minutes_apart"],
        )
        for r in got
    }
    assert found == all_pairs(sessions, patches, lines, landed, rules)
    assert {k[0] for k in found} == {"overwrite", "concurrent-edit"}


def test_meetings_again_and_again_are_not_written(spark, monkeypatch):
    """Two sessions that take turns on a line all year: one row each way, and nothing else leaves a step."""
    sessions = [(f"s{k}", "codex", None, "r", 0, 400 * DAY, None, None) for k in range(2)]
    patches = [(f"p{i:03d}", f"s{i % 2}", "r", "a.ts", i * DAY) for i in range(300)]
    lines = [(*p, side, "x") for p in patches for side in ("added", "removed")]
    written, write = [], C.materialize

    def count(df, name="step"):
        kept = write(df, name)
        written.append((name, kept.count()))
        return kept

    monkeypatch.setattr(C, "materialize", count)
    got = C.detect_collisions(
        spark.createDataFrame(patches, PATCH), spark.createDataFrame(lines, LINE), spark.createDataFrame(sessions, SESSION),
        spark.createDataFrame([], "session_id string, rel_path string"),
    )
    rows = {(r["kind"], r["session_a"], r["session_b"], r["start_ms"], r["end_ms"], r["overwritten_lines"]) for r in got.collect()}
    assert rows == {("overwrite", "s0", "s1", 0, DAY, 1), ("overwrite", "s1", "s0", DAY, 2 * DAY, 1)}
    assert max(n for _, n in written) <= 2


@pytest.mark.parametrize("rows", [1, 40])
def test_meetings_in_spans(spark, rows):
    """Cutting a file's time line into spans changes no meeting."""
    _, patches, lines = world(7, 150, hot=0.8, days=9, fps=4)
    df = spark.createDataFrame(lines, LINE).select(
        "repo_id", "rel_path", F.col("fp").alias("key"), "session_id", "ts_ms", "patch_id",
        (F.col("side") == "added").alias("early"), (F.col("side") == "removed").alias("late"),
    )
    whole, cut = C.first_meetings(df, DAY), C.first_meetings(df, DAY, rows)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect())) != []


def test_smallest_label_reaches_every_ancestor(spark):
    rng = random.Random(9)
    parents, up = [], {}
    for i in range(1, 150):
        up[i] = [i - 1 if rng.random() < 0.7 else rng.randrange(i)]
        if rng.random() < 0.2 and i > 1:
            up[i].append(rng.randrange(i))
        parents += [("r", str(i), str(p), no) for no, p in enumerate(up[i])]
    seeds = {149: "b", 120: "a", 77: "c"}
    want = {}
    for tip, label in seeds.items():
        todo, seen = [tip], set()
        while todo:
            c = todo.pop()
            if c not in seen:
                seen.add(c)
                want[c] = min(label, want.get(c, label))
                todo += up.get(c, [])
    got = G.propagate_labels(
        spark.createDataFrame([("r", str(k), v) for k, v in seeds.items()], "repo_id string, sha string, label string"),
        spark.createDataFrame(parents, "repo_id string, sha string, parent_sha string, parent_no int"),
    )
    assert {int(r["sha"]): r["label"] for r in got.collect()} == want


@pytest.mark.parametrize("wide", [64, 6, 2])
def test_similar_sessions(spark, monkeypatch, wide):
    """Against all pairs; candidates of sets up to `wide` files are decided in the join, not written."""
    rng, rules = random.Random(wide), ThreadRules()
    sessions, files = [], {}
    for i in range(150):
        start = rng.randrange(12 * 24) * HOUR
        sessions.append((f"s{i:03d}", f"r{rng.randrange(2)}", start, start + rng.randrange(30) * HOUR))
        files[f"s{i:03d}"] = {f"f{min(rng.randrange(14), rng.randrange(14))}" for _ in range(rng.randrange(10))}
    want = set()
    for a, ra, sa, _ in sessions:
        for b, rb, sb, eb in sessions:
            both, either = files[a] & files[b], files[a] | files[b]
            if ra == rb and (sb < sa or sb == sa and b > a) and sa - eb <= rules.max_gap_ms and both and len(both) / len(either) >= rules.min_jaccard:
                want.add((a, b, len(both), round(len(both) / len(either), 9)))
    frame = spark.createDataFrame(sessions, "session_id string, repo_id string, started_ms long, last_ms long")
    patches = spark.createDataFrame([(s, f) for s, fs in files.items() for f in [*fs, None, *fs]], "session_id string, rel_path string")
    written, write = [], T.materialize
    monkeypatch.setattr(T, "materialize", lambda df, name: (written.append(name), write(df, name))[1])
    got = [tuple(r) for r in T.similar_sessions(frame, patches, rules, wide).collect()]
    assert sorted((a, b, n, round(j, 9)) for a, b, n, j in got) == sorted(want)
    assert len(want) > 100 and ("similar-pairs" in written) == (wide < 9)


@pytest.mark.parametrize("marks", [1 << 26, 0])
def test_slots_are_compared_in_parts(monkeypatch, marks):
    """Rows in small batches, slots cut together, pairs in small portions, with and without a table of marks: the same pairs."""
    monkeypatch.setattr(T, "TOGETHER", 20)
    monkeypatch.setattr(T, "PROPOSED", 7)
    monkeypatch.setattr(T, "MARKS", marks)
    rng, rules, rows, want = random.Random(3), ThreadRules(), [], set()
    for i in range(200):
        start, repo = rng.randrange(20 * 24) * HOUR, f"r{rng.randrange(2)}"
        last = None if i % 17 == 0 else start + rng.randrange(90) * HOUR
        files = sorted({rng.randrange(4) + min(rng.randrange(9), rng.randrange(9)) for _ in range(1 + rng.randrange(6))})
        for slot in range(start // rules.max_gap_ms, (max(start, last or 0) + rules.max_gap_ms) // rules.max_gap_ms + 1):
            rows.append((repo, slot, start, f"s{i:03d}", last, slot == start // rules.max_gap_ms, len(files), files))
    for a in (r for r in rows if r[5]):
        for b in (r for r in rows if r[5]):
            alike = len({*a[7]} & {*b[7]}) / len({*a[7]} | {*b[7]})
            if a[0] == b[0] and (b[2] < a[2] or b[2] == a[2] and b[3] > a[3]) and b[4] is not None and a[2] - b[4] <= rules.max_gap_ms and alike >= rules.min_jaccard:
                want.add((a[3], b[3], len({*a[7]} & {*b[7]}), alike))
    rows.sort(key=lambda r: r[3], reverse=True)
    rows.sort(key=lambda r: r[:3])
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64())]
    table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=list("abcdefgh"))
    out = [tuple(r.values()) for part in T._compare(rules)(iter(table.to_batches(max_chunksize=13))) for r in part.to_pylist()]
    assert sorted(out) == sorted(want) and len(want) > 200

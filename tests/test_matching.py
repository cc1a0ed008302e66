"""Edit lines against commit lines, compared with a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from worklake.operators import matching as M

DAY = 86_400_000
LINE = "subject string, repo_id string, rel_path string, fp string, ordinal int, edit_ms long"
HIT = "repo_id string, rel_path string, fp string, sha string, commit_ms long, on_default boolean"


@pytest.mark.parametrize("before", [True, False])
def test_first_commit_at_or_after_each_line(spark, before):
    """One hot line over years (more than one span), ties in time, unknown times and keys; each input is read once."""
    rng = random.Random(3)
    key = lambda: ("r", rng.choice(["f", "f", "g", None]), rng.choice(["x", "x", "x", "y", None]))
    at = lambda: rng.choice([None, rng.randrange(900), rng.randrange(900)])
    lines = [(f"s{i}", *key(), i, d and d * DAY + rng.choice([0, 120_000, 120_001])) for i in range(300) for d in [at()]]
    hits = [(*key(), f"k{rng.randrange(40)}", d and d * DAY, rng.choice([True, False, None])) for _ in range(250) for d in [at()]]
    want = {}
    for line in lines:
        s, r, p, f, _, ms = line
        mine = [(c, k, on) for hr, hp, hf, k, c, on in hits if None not in (p, f, ms, c, hp, hf) and (hr, hp, hf) == (r, p, f)]
        later = [h for h in mine if h[0] >= ms - 120_000]
        first = min((h[:2] for h in later), default=None)
        want[s] = (bool(later), any(h[2] for h in later), *([any(h[0] < ms - 120_000 for h in mine)] if before else []), first)
    read = [spark.sparkContext.accumulator(0) for _ in range(2)]

    def seen(which):
        def told(value):
            which.add(1)
            return value

        return F.udf(told, "string").asNondeterministic()

    frames = [spark.createDataFrame(rows, schema).repartition(3) for rows, schema in ((lines, LINE), (hits, HIT))]
    counted = [df.withColumn("repo_id", seen(n)("repo_id")) for df, n in zip(frames, read, strict=True)]
    out = M.match_commits(*counted, before=before).collect()
    names = ["committed", "on_default", *(["before"] if before else [])]
    got = {r.subject: (*[r[c] for c in names], r.first_hit and tuple(r.first_hit)) for r in out}
    assert len(out) == len(lines) and got == want
    assert sum(w[0] for w in want.values()) > 20
    assert [n.value for n in read] == [len(lines), len(hits)]

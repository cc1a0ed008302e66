"""Logs that arrive in chunks against the same logs read whole, in batches and as a stream."""

import json
import random

import pytest
from test_sources import SID, item, roll

from worklake.operators.usage import merge_usage
from worklake.sources import dialect_b as B
from worklake.sources import files as S
from worklake.streaming import chunks as C

KEY = b"k"
NOW = {"availableNow": True}


def logs():
    """Three logs: contexts, counters that repeat, grow and fall back, changes at relative paths, a fork, a late header, broken lines."""
    rnd, out = random.Random(3), {}
    for k in range(3):
        sid = SID.replace("0a0b", f"{k}a{k}b")
        meta = {"id": sid, "timestamp": "2025-03-01T10:00:00Z", "cwd": "/start", "git": {"branch": "dev"}}
        if k == 1:
            meta |= {"forked_from_id": SID, "subagent_history_start_ordinal": 6}
        rows = [json.dumps(roll(0, "session_meta", meta), separators=(",", ":"))] if k < 2 else []
        total = 0
        for n in range(1, 60):
            kind = rnd.randrange(6)
            if kind == 0:
                row = roll(n, "turn_context", {"cwd": f"/w/{n}", **({"model": f"m{n}"} if n % 2 else {})})
            elif kind == 1:
                total = rnd.choice([total, total + 10, total + 5, max(0, total - 50)])
                usage = {"total_tokens": total, "input_tokens": total, "output_tokens": total // 2}
                row = roll(n, "event_msg", {"type": "token_count", "info": {"total_token_usage": usage, "last_token_usage": {"input_tokens": n}}})
            elif kind == 2:
                change = {"type": "update", "unified_diff": f"@@\n-an old line of {n}\n+a new line of {n}"}
                row = roll(n, "event_msg", item(type="FileChange", id=f"c{n}", status="completed", changes={f"a/{n}.py": change}))
            elif kind == 3:
                row = roll(n, "session_meta", {"id": "other", "cwd": "/elsewhere"})
            elif kind == 4:
                row = roll(n, "event_msg", item(type="CommandExecution", id=f"x{n}", command=["sh", "-lc", f"make {n}"], exit_code=n % 2))
            else:
                rows.append('{"broken":' if n % 2 else '"text"')
                continue
            if k == 1 and n < 6:
                row["timestamp"] = "2025-03-01T10:00:00.500Z"
            rows.append(json.dumps(row, separators=(",", ":")))
        out[f"rollout-2025-03-01T10-00-0{k}-{sid}"] = rows
    return out


def told(events, patches, usage, failures):
    """What is stored, without the places of lines."""
    ev = events.select("session_id", "parent_session_id", "event_type", "ts_ms", "cwd", "model", "call_id", "display", "file_path", "provider_version")
    pa = patches.select("session_id", "call_id", "ts_ms", "path", "operation", "added_fps", "removed_fps")
    us = merge_usage(usage).select("session_id", "usage_key", "ts_ms", "model", "input_tokens", "output_tokens")
    return [sorted(map(str, map(tuple, x.collect()))) for x in (ev, pa, us, failures.groupBy("reason").count())]


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("whole")
    for name, rows in logs().items():
        (root / f"{name}.jsonl").write_text("\n".join(rows) + "\n")
    read = B.read(S.rollout_order(S.read_lines(spark, str(root))), KEY)
    return told(read.events, read.patches, read.usage, read.failures)


def cuts(rows, rnd, parts):
    at = sorted(rnd.randrange(1, len(rows)) for _ in range(parts - 1))
    return [rows[a:b] for a, b in zip([0, *at], [*at, len(rows)], strict=True)]


def test_chunks_in_batches_equal_whole_logs(spark, tmp_path, whole):
    """Batches of any number of chunks, some without a chunk of some logs."""
    rnd = random.Random(5)
    pieces = [(name, n, part) for name, rows in logs().items() for n, part in enumerate(cuts(rows, rnd, 4)) if part]
    batches = [[p for p in pieces if p[1] < 2 and p[0] != pieces[0][0]], [p for p in pieces if p[1] == 2 or p[1] < 2 and p[0] == pieces[0][0]], [p for p in pieces if p[1] == 3]]
    state, got = C.empty_state(spark), []
    for k, batch in enumerate(batches):
        root = tmp_path / str(k)
        root.mkdir()
        for name, n, part in batch:
            (root / f"{name}.{n}.jsonl").write_text("\n".join(part) + "\n")
        lines = C.chunk_lines(S.read_lines(spark, str(root)))
        moved = lines.withColumn("file", C.F.regexp_replace("file", f"/{k}/", "/"))
        out, state = C.read_chunks(moved, state, KEY)
        got.append([out.events, out.patches, out.usage, out.failures])
    union = [a.unionByName(b).unionByName(c) for a, b, c in zip(*got, strict=True)]
    assert told(*union) == whole
    assert state.count() == 3


def test_chunks_as_a_stream_equal_whole_logs(spark, tmp_path, whole):
    rnd = random.Random(8)
    root, store = tmp_path / "in", str(tmp_path / "store")
    root.mkdir()
    cut = {name: cuts(rows, rnd, 3) for name, rows in logs().items()}
    touched = []
    for n in range(3):
        for name, parts in cut.items():
            if parts[n]:
                (root / f"{name}.{n}.jsonl").write_text("\n".join(parts[n]) + "\n")
        query = C.import_chunks(spark, str(root), KEY, store, str(tmp_path / "check"), lambda s: touched.append(s.count()), NOW)
        query.awaitTermination()
    tables = [spark.read.parquet(f"{store}/{t}") for t in ("events", "patches", "usage", "failures")]
    assert told(*tables) == whole
    assert len(touched) == 3 and all(touched)


def test_a_retried_batch_counts_once(spark, tmp_path):
    """The state a batch reads is that of the batch before, also where its own was written already."""
    path = str(tmp_path / "state")
    for n in (0, 1):
        C.empty_state(spark).unionByName(
            spark.createDataFrame([("f", 10 + n)], "file string, next_ordinal long"), allowMissingColumns=True
        ).write.parquet(f"{path}/batch={n}")
    state, older = C._version(spark, path, 1)
    assert [r.next_ordinal for r in state.collect()] == [10] and older == [0]
    assert C._version(spark, path, 0)[0].count() == 0


def test_a_repeated_total_with_other_parts_at_a_cut(spark):
    """The line after a repeated total is compared with the line that brought the total, in whichever chunk that was."""
    counts = [(100, 50), (100, 90), (100, 70), (200, 95)]
    tokens = lambda total, n: {"type": "token_count", "info": {"total_token_usage": {"total_tokens": total, "input_tokens": n}, "last_token_usage": {"input_tokens": n}}}
    values = [roll(0, "session_meta", {"id": SID, "timestamp": "2025-03-01T10:00:00Z", "cwd": "/start"})]
    values += [roll(n, "event_msg", tokens(*c)) for n, c in enumerate(counts, 1)]
    rows = [(f"rollout-2025-03-01T10-00-00-{SID}.jsonl", n, json.dumps(v, separators=(",", ":"))) for n, v in enumerate(values)]
    state, got = C.empty_state(spark), []
    for n, (lo, hi) in enumerate([(0, 3), (3, 4), (4, 5)]):
        part = spark.createDataFrame([(f, n, k - lo, v) for f, k, v in rows[lo:hi]], "file string, chunk long, ordinal long, value string")
        out, state = C.read_chunks(part, state, KEY)
        got += [(r.usage_key, r.input_tokens) for r in out.usage.collect()]
    assert got == [(f"{SID}:cum:100", 50), (f"{SID}:cum:200", 45)]


def test_texts_are_read_for_the_state_only(spark, tmp_path):
    """What a batch adds comes from its parsed lines, so the texts are not read and parsed again for each table."""
    root = tmp_path / "in"
    root.mkdir()
    for name, rows in logs().items():
        (root / f"{name}.0.jsonl").write_text("\n".join(rows) + "\n")
    out, _ = C.read_chunks(C.chunk_lines(S.read_lines(spark, str(root))), C.empty_state(spark), KEY)
    for rows in (out.events, out.patches, out.usage, out.failures):
        assert rows.inputFiles() and not any(str(root) in f for f in rows.inputFiles())

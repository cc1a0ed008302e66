import hashlib
import hmac
import unicodedata

import pytest
from pyspark.sql import functions as F

from worklake.functions import paths as P
from worklake.functions import redact as R
from worklake.functions import text as X

KEY = b"k" * 70


def values(spark, col, data, schema="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(data)], f"i int, x {schema}")
    return [r["y"] for r in df.select("i", col.alias("y")).orderBy("i").collect()]


def test_normalized_lines(spark):
    raw = ["\t let  a =  1;\r", "﻿x　y", "été", "a\u0085b", ""]
    assert values(spark, X.normalize_line(F.col("x")), raw) == ["let a = 1;", "x y", "été", "a\u0085b", ""]


def test_significance_counts_code_points(spark):
    raw = ["counter += 1", "}", "--------", "12345678", "\U0001f600" * 7 + "a", "\U0001f600" * 8, "a" * 7]
    assert values(spark, X.is_significant(F.col("x")), raw) == [True, False, False, True, True, False, False]


def test_fingerprint_is_a_keyed_hash(spark):
    line = "grüße an alle"
    want = hmac.new(KEY, unicodedata.normalize("NFC", line).encode(), hashlib.sha256).hexdigest()[:16]
    assert values(spark, X.line_fingerprint(F.col("x"), KEY), [line, "}"]) == [want, None]


def test_fnv(spark):
    def fnv(s):
        h = 2166136261
        for c in s:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        return h

    names = ["", "a", "pnpm test", "für"]
    assert values(spark, X.fnv1a(F.col("x")), names) == [fnv(n) for n in names]


@pytest.mark.parametrize(
    "text,gone",
    [
        ("header authorization: Basic dXNlcjpwYXNz end", "dXNlcjpwYXNz"),
        ("use bearer abcdefgh12345", "abcdefgh12345"),
        ("fetch ftp://me:pw123@host/x", "pw123"),
        ("MY_API_KEY = 'one two'", "one two"),
        ("run --token zzz", "zzz"),
        ("sk-proj-" + "A1" * 10, "A1A1"),
        ("ghp_" + "q" * 24, "qqqq"),
        ("glpat-" + "w" * 22, "wwww"),
        ("xoxp-" + "1" * 12, "1111"),
        ("npm_" + "n" * 32, "nnnn"),
        ("id AKIA" + "Z" * 16 + " x", "ZZZZ"),
        ("AIza" + "y" * 35, "yyyy"),
        ("eyJ" + "a" * 9 + "." + "b" * 9 + "." + "c" * 9, "bbbb"),
        ("-----BEGIN EC PRIVATE KEY-----\nMHc\n-----END EC PRIVATE KEY-----", "MHc"),
        ("-----BEGIN PRIVATE KEY-----\nunfinished", "unfinished"),
    ],
)
def test_secrets_are_removed(spark, text, gone):
    df = spark.createDataFrame([(text,)], "x string")
    row = R.redact(df, "x", "clean", "n", "tally").first()
    assert gone not in row["clean"] and R.REDACTED in row["clean"] and row["n"] >= 1
    assert sum(row["tally"]) == row["n"]


def test_plain_text_stays(spark):
    plain = ["ls -l src/token", "make passthrough", "git log --author x", "a secretary wrote"]
    df = spark.createDataFrame([(p,) for p in plain], "x string")
    assert all(r["x"] == r["clean"] and r["n"] == 0 for r in R.redact(df, "x", "clean", "n").collect())


def test_commands(spark):
    cases = {
        "cd x && npm run build": ("npm", "cd x && npm run build", 0),
        "A=1 B=2 sudo /bin/tar xf y": ("tar", "A=1 B=2 sudo /bin/tar xf y", 0),
        "git commit -m 'all of the words'\nrest": ("git", "git commit -m '[TEXT]'", 1),
        'say "two words" "' + "z" * 49 + '"': ("say", 'say "two words" "[TEXT]"', 1),
        'm "a \\"b\\" c d"': ("m", 'm "[TEXT]"', 1),
        "DB_PASSWORD=x run": ("run", "DB_PASSWORD=[REDACTED] run", 1),
        "cd /only": (None, "cd /only", 0),
        "x" * 400: ("x" * 299 + "…", "x" * 299 + "…", 0),
    }
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    for r in R.sanitize_command(df, "c", longest=300).collect():
        exe, shown, n = cases[r["c"]]
        assert (r["display"], r["redactions"]) == (shown, n)
        if len(r["c"]) < 300:
            assert r["executable"] == exe


def test_paths(spark):
    cats = {
        "src/test/a.ts": "Tests", "b.spec.js": "Tests", "docs/x.py": "Docs", "R.MD": "Docs", ".config/x": "Config",
        "w.yaml": "Config", "p.vue": "UI", "db/migrations/1.py": "Database", "run.sh": "Infra", "Dockerfile": "Infra", "m.rs": "Code",
    }
    assert values(spark, P.path_category(F.col("x")), list(cats)) == list(cats.values())
    branches = {"feat/web-hook_retry": "web hook retry", "Fix_a": "a", "main": "main", "feat/": "feat/"}
    assert values(spark, P.humanize_branch(F.col("x")), list(branches)) == list(branches.values())
    headers = {"b/a.ts": "a.ts", "b/with space\t": "with space", '"b/\\303\\244\\t.c"': "ä\t.c", "/dev/null": None}
    assert values(spark, P.diff_path(F.col("x")), list(headers)) == list(headers.values())


def test_query_terms(spark):
    got = values(spark, X.query_terms(F.col("x")), ["Fix the Retry-logic, retry-logic v2.0!", "the and for", "ab"])
    assert got == [["retry-logic", "v2.0"], ["the", "and", "for"], []]


def test_composition_stays_in_the_jvm(spark):
    """Equal to Python's composition, for any script, without Python on the executors."""
    import random
    import unicodedata

    from worklake.functions.text import nfc

    rnd = random.Random(1)
    blocks = [(0x20, 0x3000), (0x3040, 0x3100), (0xAC00, 0xAD00), (0xF900, 0xFB50), (0x1D150, 0x1D170), (0x2F800, 0x2F900)]
    pool = [chr(c) for a, b in blocks for c in range(a, b) if unicodedata.category(chr(c)) != "Cn"]
    texts = ["".join(rnd.choices(pool, k=10)) for _ in range(5000)]
    texts += ["", None, "плащ й", "й", "中文文本", "“quoted” — dash", "ẹ́", "한", "a" * 50_000 + "́"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", nfc(F.col("t")).alias("n"))
    assert all(r.n == (None if r.t is None else unicodedata.normalize("NFC", r.t)) for r in rows.collect())
    assert "Python" not in rows._jdf.queryExecution().toString()


def test_quoted_spans_as_long_as_a_text(spark):
    """Spans are masked whole, however long, and end where a shorter one would."""
    rows = [(1, "ab " * 100_000, ""), (2, "a\\\" b c d " * 20_000, ""), (3, "x", "' it" * 30_001)]
    made = spark.createDataFrame(rows, "k long, body string, tail string").withColumn(
        "c", F.concat(F.lit('run "'), "body", F.lit('" z'), "tail")
    )
    shown = {r.k: r.display for r in R.sanitize_command(made, "c").collect()}
    assert shown[1] == shown[2] == 'run "[TEXT]" z'
    assert shown[3] == 'run "x" z' + "' it' it" * 15_000 + "' it"
    open_end = spark.createDataFrame([(r'go "a b c \" d',), (r'go "a \" b\n"c',)], "c string")
    assert [r.display for r in R.sanitize_command(open_end, "c").collect()] == ['go "[TEXT]" d', 'go "[TEXT]"c']

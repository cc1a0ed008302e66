"""Quality rules: a table of thresholds, compiled into one projection.

Each rule bounds a ratio of two counts, `low <= 1000 * a / b <= high`, worked out in whole numbers; a
grace is added to `a` for the lower bound, so that a short text may lack one.
The counts (words, characters, symbols, stop words, lines) come from built-in functions only; words
are split once a row and kept in a lambda variable.

Null text has no words, so it fails the base rule (`n_words < 10`). An empty table gives an empty
one. Repeated rows and ids, and so ties, are judged row by row. Very long texts are judged whole. Other
columns are carried whatever their names. Windows are compared by 64-bit hashes within one
text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklake.llm.tables import let

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

# Very common words of four languages.
STOP_WORDS = {
    "en": "the of and to in a is that for it on was with be as by are this at from or an have not",
    "fr": "le la les de des du et en un une que qui est dans pour par sur pas au elle il ce ne se",
    "de": "der die das und in zu den mit von ist des auf für im nicht ein eine als auch es an er sie dem",
    "es": "el la los las de del y en un una que se es por con para no su al lo como más esta ser",
}


@dataclass(frozen=True)
class Rule:
    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None
    languages: tuple[str, ...] = ()
    grace: int = 0


#: Per 1000. A rule with languages is asked only of texts in one of them.
RULES = (
    Rule("word_length", "word_chars", "n_words", 1500, 25000),
    Rule("symbols", "n_symbols", "n_words", None, 100),
    Rule("shouted", "n_shouts", "n_words", None, 100),
    Rule("stop_words", "n_stop_words", "n_words", 60, None, tuple(STOP_WORDS), grace=1),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 400),
    Rule("cut_lines", "n_cut_lines", "n_lines", None, 300),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 900),
)
MIN_WORDS = 10
MAX_REPEATED = 20
WINDOW = 5

METRICS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_shouts", "n_stop_words", "n_lines", "n_cut_lines", "n_bullet_lines",
]


def _without(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


def _covered(hashes: Column) -> Column:
    """Words in windows of which an equal one exists, from the window hashes of one text."""

    def repeated(by_hash: Column) -> Column:
        def equal(k: Column, step: int) -> Column:
            return F.get(by_hash, k)["h"] == F.get(by_hash, k + F.lit(step))["h"]

        at = F.sequence(F.lit(0), F.size(by_hash) - 1)
        starts = F.transform(
            F.filter(at, lambda k: equal(k, -1) | equal(k, 1)), lambda k: F.get(by_hash, k)["i"]
        )
        return let(
            F.sort_array(starts),
            lambda s: F.aggregate(
                F.sequence(F.lit(1), F.size(s) - 1),
                F.lit(WINDOW).cast("long"),
                lambda n, k: n + F.least(F.lit(WINDOW), F.get(s, k) - F.get(s, k - 1)),
            ),
        )

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(pairs, repeated)).otherwise(F.lit(0).cast("long"))


def _repeat_words(words: Column) -> Column:
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.xxhash64(*[F.get(words, i + F.lit(k)) for k in range(WINDOW)]),
    )
    return F.when(F.size(words) > WINDOW, let(windows, _covered)).otherwise(F.lit(0).cast("long"))


def _metrics(text: Column) -> Column:
    """An array of one struct of METRICS."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    words = F.array_remove(F.split(t, "[\\x20\\x09-\\x0D]+"), "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(WHITE)) != "")
    stops = sorted({w for ws in STOP_WORDS.values() for w in ws.split()})

    def counts(v: Column) -> Column:
        w, ls, s = v["w"], v["l"], v["t"]
        long = lambda c: c.cast("long")
        return F.struct(
            long(F.size(w)).alias("n_words"),
            long(_without(s, WHITE)).alias("word_chars"),
            long(F.char_length(s) - _without(s, SYMBOLS)).alias("n_symbols"),
            long(F.size(ls) - F.size(F.array_distinct(ls))).alias("n_dup_lines"),
            let(w, _repeat_words).alias("n_repeat_words"),
            long(F.char_length(s) - _without(s, "!")).alias("n_shouts"),
            long(F.size(F.filter(w, lambda x: F.lower(x).isin(stops)))).alias("n_stop_words"),
            long(F.size(ls)).alias("n_lines"),
            long(F.size(F.filter(ls, lambda x: F.trim(x, F.lit(WHITE)).endswith("...")))).alias("n_cut_lines"),
            long(
                F.size(F.filter(ls, lambda x: F.substring(F.ltrim(x, F.lit(WHITE)), 1, 1).isin("-", "*", "•")))
            ).alias("n_bullet_lines"),
        )

    return F.transform(F.array(F.struct(words.alias("w"), lines.alias("l"), t.alias("t"))), counts)


def metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with a struct column `__m` of METRICS."""
    return docs.withColumn("__m", F.explode(_metrics(F.col(text))))


def _passes(rule: Rule, lang: Column, m: Column) -> Column:
    ok = F.lit(True)
    if rule.low is not None:
        ok = ok & ((m[rule.part] + rule.grace) * 1000 >= m[rule.whole] * rule.low)
    if rule.high is not None:
        ok = ok & (m[rule.part] * 1000 <= m[rule.whole] * rule.high)
    return ok | ~F.coalesce(lang.isin(*rule.languages), F.lit(False)) if rule.languages else ok


def _verdict(m: Column, rules: tuple[Rule, ...], lang: Column) -> tuple[Column, Column]:
    """Whether the base rule fails, and whether all rules pass."""
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED * m["n_words"])
    kept = ~failed
    for rule in rules:
        kept = kept & _passes(rule, lang, m)
    return failed, kept


def _language(docs: DataFrame, lang: str) -> Column:
    return F.col(lang) if lang in docs.columns else F.lit(None).cast("string")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", lang: str = "lang") -> DataFrame:
    """`docs` with `__m` and the booleans `__base_failed` and `__kept`, one row for each row."""
    failed, kept = _verdict(F.col("__m"), rules, _language(docs, lang))
    return metrics(docs, text).withColumn("__base_failed", failed).withColumn("__kept", kept)


def report(docs: DataFrame) -> DataFrame:
    """One row a document: its counts, `base_failed` and `kept`."""
    m = [F.col("__m")[name].alias(name) for name in METRICS]
    lang = [F.col("lang")] if "lang" in docs.columns else []
    return judge(docs.select("doc_id", "text", *lang)).select(
        "doc_id", *m, F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept")
    )


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that pass, with their own columns: one condition, so that no row is copied beside its text."""
    passes = F.transform(_metrics(F.col(text)), lambda m: _verdict(m, rules, _language(docs, lang))[1])
    return docs.filter(F.get(passes, F.lit(0)))

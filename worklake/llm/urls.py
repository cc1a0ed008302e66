"""URL filters: rules indexed by their rarest literal token.

A pattern rule is a regular expression with literal tokens that every match has to contain. The
rule is filed under the one of them that fewest of the given URLs contain. A URL's tokens fetch the
rules filed under them, and only those run their expression. Rules without a token are fetched by
all URLs. A list of (host, path, verdict) rules is decided in the same way: each is filed under a label of
its host, fits the host and its subdomains, and the longest fitting rule wins.

Null URLs and those without `://` have an empty host and path, fit no host rule and are allowed
unless a pattern fits the URL. Repeated rows are judged one by one; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worklake.llm.tables import broadcast_if_small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this number are broadcast; beyond, URL tokens and rules meet by shuffle.
BROADCAST_RULES = 200_000


@dataclass(frozen=True)
class HostRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Pattern:
    """`tokens`: lower-case runs of [a-z0-9]+ one of which is enough to file the rule under; all occur in each match."""

    regex: str
    tokens: tuple[str, ...]
    verdict: str = "block"


#: Longest match wins.
HOST_RULES = (
    HostRule("com", "/", "allow"),
    HostRule("example.com", "/en/", "block"),
    HostRule("www.example.com", "/en/", "allow"),
    HostRule("net", "/es/", "block"),
    HostRule("net", "/fr/", "block"),
)
PATTERNS = (
    Pattern(r"(?i)://[^/?#]*\bcheap-pills\b", ("cheap", "pills")),
    Pattern(r"(?i)://[^/?#]*\bspam-[a-z]+", ("spam",)),
    Pattern(r"(?i)://[^/?#]*\b(?:online|best)-casino\b", ("casino",)),
    Pattern(r"(?i)://(?:[^/?#]*[.-])?(?:xxx|porn)(?:[.-][^/?#]*)?(?:[/?#]|$)", ()),
    Pattern(r"(?i)[?&](?:sessionid|phpsessid)=[0-9a-z]{16,}", ()),
    Pattern(r"(?i)\.(?:exe|apk|dmg|iso)(?:[?#]|$)", ()),
)


def host(url: Column) -> Column:
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(value: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.translate(value, UPPER, LOWER), "[^a-z0-9]+"), ""))


def _literal_tokens(rules: list[tuple]) -> set[str]:
    return {t for r in rules for t in r[3]}


def _filed(spark: SparkSession, urls: DataFrame, hosts: tuple[HostRule, ...], patterns: tuple[Pattern, ...]) -> DataFrame:
    """Rules with the token each is filed under; null where a rule has none.

    How many URLs hold each literal is counted over all of them; the counts, at most one for each
    literal of the rules, decide.
    """
    rows = [(i, "host", h.name, tuple(re.findall("[a-z0-9]+", h.host)), h.host, h.path, "", h.verdict) for i, h in enumerate(hosts)]
    rows += [(len(hosts) + i, "pattern", p.regex, p.tokens, "", "", p.regex, p.verdict) for i, p in enumerate(patterns)]
    schema = "rule_id int, kind string, rule string, tokens array<string>, r_host string, r_path string, regex string, r_verdict string"
    rules = spark.createDataFrame(rows, schema)
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    held = urls.select(F.explode(_tokens(F.col("__url"))).alias("token")).join(
        broadcast_if_small(wanted, BROADCAST_RULES), "token"
    )
    seen = held.groupBy("token").agg(F.count("*").alias("n"))
    best = (
        rules.select("rule_id", F.explode("tokens").alias("token"))
        .join(seen, "token", "left")
        .groupBy("rule_id")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("b"))
        .select("rule_id", F.col("b.token").alias("token"))
    )
    return rules.drop("tokens").join(best, "rule_id", "left")


def judge(
    pages: DataFrame,
    hosts: tuple[HostRule, ...] = HOST_RULES,
    patterns: tuple[Pattern, ...] = PATTERNS,
    url: str = "url",
) -> DataFrame:
    """`pages` with `__host`, `__path`, `__rule` (host rule that decided, or null), `__pattern`, `__verdict`.

    A host rule decides before a pattern does. Between host rules of one length the longer host
    wins, then the smaller name. Equal URLs are judged once and joined back, so a URL that many
    pages share costs one look-up.
    """
    spark = pages.sparkSession
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    pages = pages.withColumn("__url", u)
    urls = pages.select("__url").distinct()
    rules = _filed(spark, urls, hosts, patterns)
    parts = urls.withColumn("__host", host(F.col("__url"))).withColumn("__path", path(F.col("__url")))
    by_token = (
        parts.withColumn("token", F.explode(_tokens(F.col("__url"))))
        .join(broadcast_if_small(rules.filter("token is not null"), BROADCAST_RULES), "token")
        .drop("token")
    )
    whole = [p for p in patterns if not p.tokens]  # every URL fetches these: a part of the given list
    always = F.array(
        *[
            F.struct(
                F.lit("pattern").alias("kind"), F.lit(p.regex).alias("rule"), F.lit("").alias("r_host"),
                F.lit("").alias("r_path"), F.lit(p.regex).alias("regex"), F.lit(p.verdict).alias("r_verdict"),
            )
            for p in whole
        ]
    )
    fetched = by_token.drop("rule_id")
    if whole:
        rest = parts.select("__url", "__host", "__path", F.explode(always).alias("r"))
        fetched = fetched.unionByName(rest.select("__url", "__host", "__path", "r.*"))
    h, p = F.col("r_host"), F.col("r_path")
    fits_host = (F.col("__host") == h) | F.endswith(F.col("__host"), F.concat(F.lit("."), h))
    fits = F.when(F.col("kind") == "host", fits_host & F.startswith(F.col("__path"), p)).otherwise(
        F.expr("__url rlike regex")
    )
    first = F.struct(
        F.when(F.col("kind") == "host", 0).otherwise(1).alias("k"),
        (-F.length("rule")).alias("l"),
        (-F.length("r_host")).alias("h"),
        "rule",
        "r_verdict",
    )
    won = fetched.filter(fits).groupBy("__url").agg(F.min(first).alias("w"))
    is_host = F.col("w.k") == 0
    judged = parts.join(won, "__url", "left").select(
        "__url",
        "__host",
        "__path",
        F.when(is_host, F.col("w.rule")).alias("__rule"),
        F.when(F.col("w.k") == 1, F.col("w.rule")).alias("__pattern"),
        F.coalesce("w.r_verdict", F.lit("allow")).alias("__verdict"),
    )
    return pages.join(judged, "__url").drop("__url")


def report(pages: DataFrame) -> DataFrame:
    """One row a page: host, path, rule and verdict."""
    return judge(pages.select("page_id", "url")).select(
        "page_id",
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        F.col("__rule").alias("rule"),
        F.col("__verdict").alias("verdict"),
    )

"""Secret redaction and command display, as chains of regex projections over whole texts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklake.functions.text import NOT_SPACE, SPACE, SPACE_CHARS

REDACTED = "[REDACTED]"
MASKED = "[TEXT]"
MAX_KEPT_QUOTED = 48

# What counts as a secret. Order matters (structured forms before token shapes).
# B is an ASCII word boundary in front of a word character, E one behind it.
B = r"(?<![A-Za-z0-9_])"
E = r"(?![A-Za-z0-9_])"
SECRET_NAME = (
    "[A-Za-z0-9_]*(?:SECRET|TOKEN|PASSWORD|PASSWD|API_?KEY|PRIVATE_?KEY|ACCESS_?KEY|CREDENTIALS?)"
    "[A-Za-z0-9_]*"
)
SECRET_RULES: list[tuple[str, str, str]] = [
    (
        "private_key",
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|\z)",
        REDACTED,
    ),
    (
        "authorization",
        rf"(?i){B}(authorization{SPACE}*[:=]{SPACE}*)(?:(?:bearer|basic|token){SPACE}+)?[^{SPACE_CHARS}'\"]+",
        f"$1{REDACTED}",
    ),
    ("bearer", rf"(?i){B}(bearer{SPACE}+)[A-Za-z0-9._~+/-]{{8,}}=*", f"$1{REDACTED}"),
    (
        "url_credentials",
        rf"(?i){B}([a-z][a-z0-9+.-]*://)[^/{SPACE_CHARS}:@'\"]+:[^/{SPACE_CHARS}@'\"]+@",
        f"$1{REDACTED}@",
    ),
    (
        "named_secret",
        rf"(?i){B}({SECRET_NAME})({SPACE}*[=:]{SPACE}*)(\"[^\"]*\"|'[^']*'|[^{SPACE_CHARS}'\"]+)",
        f"$1$2{REDACTED}",
    ),
    (
        "secret_flag",
        rf"(?i)(--?(?:password|passwd|pass|token|api-?key|secret)(?:=|{SPACE}+))(\"[^\"]*\"|'[^']*'|{NOT_SPACE}+)",
        f"$1{REDACTED}",
    ),
    ("sk_key", rf"{B}sk-(?:ant-|proj-)?[A-Za-z0-9_-]{{16,}}", REDACTED),
    (
        "git_host_token",
        rf"{B}(?:ghp|gho|ghs|ghu|ghr)_[A-Za-z0-9]{{20,}}|{B}github_pat_[A-Za-z0-9_]{{20,}}",
        REDACTED,
    ),
    ("glpat", rf"{B}glpat-[A-Za-z0-9_-]{{20,}}", REDACTED),
    ("xox", rf"{B}xox[abprs]-[A-Za-z0-9-]{{10,}}", REDACTED),
    ("npm", rf"{B}npm_[A-Za-z0-9]{{30,}}", REDACTED),
    ("akia", rf"{B}(?:AKIA|ASIA)[0-9A-Z]{{16}}{E}", REDACTED),
    ("aiza", rf"{B}AIza[0-9A-Za-z_-]{{35}}{E}", REDACTED),
    ("jwt", rf"{B}eyJ[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{8,}}", REDACTED),
]
# Lower-case literals of which a text must hold one before a rule can match at all.
RULE_HINTS: dict[str, tuple[str, ...]] = {
    "private_key": ("-----begin ",),
    "authorization": ("authorization",),
    "bearer": ("bearer",),
    "url_credentials": ("://",),
    "named_secret": (
        "secret", "token", "password", "passwd", "apikey", "api_key", "privatekey", "private_key",
        "accesskey", "access_key", "credential",
    ),
    "secret_flag": ("-pass", "-token", "-api", "-secret"),
    "sk_key": ("sk-",),
    "git_host_token": ("ghp_", "gho_", "ghs_", "ghu_", "ghr_", "github_pat_"),
    "glpat": ("glpat-",),
    "xox": ("xox",),
    "npm": ("npm_",),
    "akia": ("akia", "asia"),
    "aiza": ("aiza",),
    "jwt": ("eyj",),
}
PREFIX_WORDS = ("sudo", "env", "time", "nohup", "exec", "command", "builtin")
# A quoted span: up to the first quote that is not escaped, else up to the last one of the line. Both loops are of
# kinds that Java walks without recursion, so a span may be as long as a text.
QUOTED = r"""(["'])(?:(?:\\.|(?!\1).)*+\1|.*\1)"""
HOME_DIR = rf"""(^|[{SPACE_CHARS}"'`=:(,\[])/(?:Users|home)/[^/{SPACE_CHARS}"'`]+"""


def redact(df: DataFrame, col: str, out: str, count: str, by_rule: str | None = None) -> DataFrame:
    """Adds the redacted text, the number of redactions and optionally the tally per rule.

    One projection per rule: each step reads the previous step's text once, and Catalyst keeps the
    steps apart instead of inlining them into one exponential expression. A rule's regex only runs
    on texts that hold one of its literals; replacements never create one, so the original decides.
    """
    cur = F.col(col)
    df = df.withColumn("__t0", cur).withColumn("__n0", F.lit(0)).withColumn("__low", F.lower(cur))
    hints = [
        reduce(or_, [F.contains(F.col("__low"), F.lit(h)) for h in RULE_HINTS[name]]) for name, _, _ in SECRET_RULES
    ]
    df = df.withColumn("__may", F.array(*hints)).drop("__low")
    tallies = []
    for i, (name, pattern, replacement) in enumerate(SECRET_RULES):
        hit = F.regexp_count(F.col(f"__t{i}"), F.lit(pattern))
        df = df.withColumn(f"__n{i + 1}", F.when(F.col("__may")[i], hit).otherwise(F.lit(0)))
        df = df.withColumn(
            f"__t{i + 1}",
            F.when(F.col(f"__n{i + 1}") > 0, F.regexp_replace(f"__t{i}", pattern, replacement))
            .otherwise(F.col(f"__t{i}")),
        ).drop(f"__t{i}")
        tallies.append((name, F.col(f"__n{i + 1}")))
    total = sum((c for _, c in tallies), F.col("__n0"))
    df = df.withColumn(out, F.col(f"__t{len(SECRET_RULES)}")).withColumn(count, total)
    if by_rule:
        df = df.withColumn(by_rule, F.struct(*[c.alias(n) for n, c in tallies]))
    return df.drop("__may", f"__t{len(SECRET_RULES)}", *[f"__n{i}" for i in range(len(SECRET_RULES) + 1)])


def redact_text(text: Column) -> Column:
    """Only the redacted text, as a plain expression (display strings).

    Most strings hold no rule's literal and meet no regex.
    """
    clean = text
    for _, pattern, replacement in SECRET_RULES:
        clean = F.regexp_replace(clean, pattern, replacement)
    literals = sorted({h for hints in RULE_HINTS.values() for h in hints})
    low = F.lower(text)
    return F.when(reduce(or_, [F.contains(low, F.lit(h)) for h in literals]), clean).otherwise(text)


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def _is_prose(span: Column) -> Column:
    body = span.substr(F.lit(2), F.length(span) - 2)
    words = F.size(F.filter(F.split(body, f"{SPACE}+"), lambda w: w != ""))
    return (words >= 3) | (F.length(body) > MAX_KEPT_QUOTED)


def _mask(span: Column) -> Column:
    quote = F.substring(span, 1, 1)
    return F.when(_is_prose(span), F.concat(quote, F.lit(MASKED), quote)).otherwise(span)


def command_executable(command: Column) -> Column:
    """Program of the first meaningful segment: no prefixes, assignments or directory changes."""

    def program(segment: Column) -> Column:
        words = F.transform(
            F.split(trim_space(segment), f"{SPACE}+"),
            lambda w: F.regexp_replace(w, r"""^['"(]+|['")]+$""", ""),
        )
        useful = F.filter(
            words,
            lambda w: (w != "")
            & ~w.rlike("^[A-Za-z_][A-Za-z0-9_]*=")
            & ~w.isin(*PREFIX_WORDS),
        )
        return F.get(useful, F.lit(0))

    programs = F.filter(
        F.transform(F.split(command, r"&&|\|\||;|\|"), program),
        lambda w: w.isNotNull() & (w != "cd"),
    )
    bases = F.filter(
        F.transform(programs, lambda w: F.element_at(F.split(w, "/"), -1)),
        lambda b: (b != "") & (b != REDACTED),
    )
    return F.get(bases, F.lit(0))


def sanitize_command(df: DataFrame, col: str, longest: int | None = None) -> DataFrame:
    """Adds executable, display and redactions for a shell command column (null stays null).

    `longest` cuts what is displayed; without it the whole line is kept.
    """
    df = df.withColumn("__line", F.get(F.split(trim_space(F.col(col)), "\r?\n", 2), F.lit(0)))
    df = redact(df, "__line", "__clean", "__secrets")
    # Pieces around the quoted spans, then the spans put back one by one, masked where prose.
    df = df.withColumn("__spans", F.regexp_extract_all("__clean", F.lit(QUOTED), F.lit(0)))
    df = df.withColumn("__pieces", F.split("__clean", QUOTED, -1))
    df = df.withColumn(
        "__shown",
        F.array_join(
            F.zip_with(
                "__pieces", "__spans", lambda p, s: F.concat(p, F.coalesce(_mask(s), F.lit("")))
            ),
            "",
        ),
    ).withColumn("__masked", F.size(F.filter("__spans", _is_prose)))
    shown = F.col("__shown")
    return (
        df.withColumn("executable", command_executable(shown))
        .withColumn(
            "display",
            shown if longest is None else F.when(
                F.length(shown) > longest, F.concat(F.substring(shown, 1, longest - 1), F.lit("…"))
            ).otherwise(shown),
        )
        .withColumn("redactions", F.when(F.col(col).isNull(), 0).otherwise(F.col("__secrets") + F.col("__masked")))
        .drop("__line", "__clean", "__secrets", "__spans", "__pieces", "__shown", "__masked")
    )


def privacy_filter(text: Column, cap: int | None = None) -> Column:
    """Output strings: redacted again, home folders shown as ~; cut to `cap` characters where one is given."""
    shown = F.regexp_replace(redact_text(text), HOME_DIR, "$1~")
    if cap is None:
        return shown
    return F.when(F.length(shown) > cap, F.concat(F.substring(shown, 1, cap), F.lit("…"))).otherwise(shown)

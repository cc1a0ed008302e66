"""Line text: canonical form, significance, keyed fingerprints, content keys, small hashes.

Everything here is a column expression that stays in the JVM.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace class of the source log format (ECMAScript) and line thresholds.
SPACE_CHARS = (
    r"\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
SPACE = f"[{SPACE_CHARS}]"
# Whitespace that is not already one plain space; ordinary word gaps are left alone by the regex.
ODD_SPACE_CHARS = SPACE_CHARS.replace(r"\f\r ", r"\f\r")
UNTIDY = f" *[{ODD_SPACE_CHARS}]{SPACE}*| {{2,}}"
NOT_SPACE = f"[^{SPACE_CHARS}]"
MIN_LINE_LENGTH = 8
FP_HEX = 16
# All code points below U+0300 are already composed, so most text never leaves the JVM.
MAYBE_DECOMPOSED = r"[^\x{00}-\x{2FF}]"


def nfc(text: Column) -> Column:
    """Unicode NFC, by the ICU library that Spark's collations use; text below U+0300 is left alone.

    Apply to whole texts before splitting: composition never crosses a newline.
    """
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    return F.when(text.rlike(MAYBE_DECOMPOSED), composed).otherwise(text)


def squeeze(text: Column) -> Column:
    """Whitespace runs to one space, trimmed; expects composed text."""
    return F.trim(F.regexp_replace(text, UNTIDY, " "))


def normalize_line(line: Column) -> Column:
    return squeeze(nfc(line))


def is_significant(normalized: Column) -> Column:
    return (F.length(normalized) >= MIN_LINE_LENGTH) & normalized.rlike(r"[\p{L}\p{N}]")


def hmac_pads(key: bytes) -> tuple[str, str]:
    """Hex of the inner and outer HMAC-SHA256 pads for a key."""
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def hmac_sha256(text: Column, key: bytes) -> Column:
    ipad, opad = hmac_pads(key)
    inner = F.sha2(F.concat(F.unhex(F.lit(ipad)), F.encode(text, "UTF-8")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(opad)), F.unhex(inner)), 256)


def line_fingerprint(normalized: Column, key: bytes) -> Column:
    """16 hex digits of the keyed hash, null for lines that carry no signal."""
    return F.when(
        is_significant(normalized), F.substring(hmac_sha256(normalized, key), 1, FP_HEX)
    )


def significant_lines(lines: Column) -> Column:
    """Distinct normalized significant lines of an array, in first-occurrence order."""
    return F.array_distinct(F.filter(F.transform(lines, squeeze), is_significant))


def fingerprint_all(lines: Column, key: bytes) -> Column:
    return F.transform(
        significant_lines(lines), lambda n: F.substring(hmac_sha256(n, key), 1, FP_HEX)
    )


def fingerprint_diff(added: Column, removed: Column, key: bytes) -> Column:
    """struct(added, removed): a line on both sides was only moved and is not new work."""
    fp = lambda arr: F.transform(arr, lambda n: F.substring(hmac_sha256(n, key), 1, FP_HEX))
    gone = significant_lines(removed)
    return F.struct(
        fp(F.array_except(significant_lines(added), gone)).alias("added"),
        fp(gone).alias("removed"),
    )


def split_lines(text: Column) -> Column:
    return F.split(text, "\r?\n")


def iso_ms(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts)


def content_hash(fields: dict[str, Column]) -> Column:
    """32 hex digits over canonical JSON: keys sorted, null members omitted."""
    canonical = F.to_json(F.struct(*[c.alias(k) for k, c in sorted(fields.items())]))
    return F.substring(F.sha2(canonical, 256), 1, 32)


def event_fingerprint(
    provider, provider_event_id, provider_event_type, session_id, event_type, ts, sequence,
    call_id, file_path, command,
) -> Column:
    return content_hash({
        "v": F.lit(1),
        "provider": provider,
        "providerEventId": provider_event_id,
        "providerEventType": provider_event_type,
        "sessionId": session_id,
        "eventType": event_type,
        "at": iso_ms(ts),
        "sequence": sequence,
        "toolCallId": call_id,
        "filePath": file_path,
        "command": command,
    })


def patch_key(session_id, call_id, path, ts, operation, added, removed) -> Column:
    return content_hash({
        "v": F.lit(1),
        "sessionId": session_id,
        "toolCallId": call_id,
        "path": path,
        "at": epoch_ms(ts),
        "operation": operation,
        "added": added,
        "removed": removed,
    })


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the characters, as an unsigned long."""
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619)).bitwiseAND(
        F.lit(0xFFFFFFFF)
    )
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(2166136261).cast("long"), step)


def base36(n: Column) -> Column:
    return F.lower(F.conv(n.cast("string"), 10, 36))


def agent_name(provider: Column) -> Column:
    words = F.transform(
        F.split(provider, "-"),
        lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))),
    )
    return F.array_join(words, " ")


def compact_count(n: Column) -> Column:
    # One decimal by the exact binary value; values that really end in a half go up.
    half = lambda x: x * 4 == F.floor(x * 4)
    one = lambda x: F.regexp_replace(
        F.format_number(F.when(half(x), F.round(x, 1)).otherwise(x), 1), ",", ""
    )
    return (
        F.when(n >= 10**9, F.concat(one(n / 10**9), F.lit("B")))
        .when(n >= 10**6, F.concat(one(n / 10**6), F.lit("M")))
        .when(n >= 10**3, F.concat(F.floor(n / 1000 + 0.5).cast("string"), F.lit("k")))
        .otherwise(n.cast("string"))
    )


def wilson(k: Column, n: Column, z: float = 1.645) -> Column:
    """struct(lo, hi): interval of a proportion, (0, 0) without a sample."""
    p = k / n
    denom = 1 + F.lit(z * z) / n
    center = (p + F.lit(z * z) / (2 * n)) / denom
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n)) / denom
    empty = n == 0
    return F.struct(
        F.when(empty, 0.0).otherwise(F.greatest(F.lit(0.0), center - half)).alias("lo"),
        F.when(empty, 0.0).otherwise(F.least(F.lit(1.0), center + half)).alias("hi"),
    )


def local_day(date: Column, tz: str) -> Column:
    """struct(from, to): UTC instants bounding a calendar day in a time zone."""
    return F.struct(
        F.to_utc_timestamp(date.cast("timestamp"), tz).alias("from"),
        F.to_utc_timestamp(F.date_add(date, 1).cast("timestamp"), tz).alias("to"),
    )


# Words that say nothing about a search.
STOP_WORDS = ("the", "and", "for", "with", "from", "into", "that", "this", "fix", "add")


def query_terms(query: Column) -> Column:
    words = F.transform(
        F.split(F.lower(query), r"[^\p{L}\p{N}_.\-]+"),
        lambda t: F.regexp_replace(t, r"^[.\-]+|[.\-]+$", ""),
    )
    terms = F.filter(words, lambda t: F.length(t) >= 3)
    useful = F.filter(terms, lambda t: ~t.isin(*STOP_WORDS))
    return F.array_distinct(F.when(F.size(useful) > 0, useful).otherwise(terms))

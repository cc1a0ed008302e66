"""Typed reads from parsed JSON (VARIANT): a value of another type counts as absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIMESTAMP = (
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"
)


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once per row.

    A filter on a plain projected column is pushed below it as a copy of the whole expression, so
    every filter on a parsed field would parse the JSON again. Output of a generator is not
    rewritten that way; one-element `inline` stays inside whole-stage codegen.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, F.inline(F.array(row)))


def node(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "variant")


def _kind(doc: Column, path: str) -> Column:
    return F.schema_of_variant(node(doc, path))


def text(doc: Column, path: str) -> Column:
    """Non-empty string, else null."""
    value = F.try_variant_get(doc, path, "string")
    return F.when((_kind(doc, path) == "STRING") & (value != ""), value)


def any_text(doc: Column, path: str) -> Column:
    """String, possibly empty, else null."""
    return F.when(_kind(doc, path) == "STRING", F.try_variant_get(doc, path, "string"))


def count(doc: Column, path: str) -> Column:
    """Non-negative number as a long, else null."""
    value = F.try_variant_get(doc, path, "double")
    numeric = _kind(doc, path).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    return F.when(numeric & (value >= 0), value.cast("long"))


def amount(doc: Column, path: str) -> Column:
    value = F.try_variant_get(doc, path, "double")
    numeric = _kind(doc, path).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    return F.when(numeric & (value >= 0), value)


def flag(doc: Column, path: str) -> Column:
    """True only for a JSON true."""
    return F.coalesce(
        (_kind(doc, path) == "BOOLEAN") & F.try_variant_get(doc, path, "boolean"), F.lit(False)
    )


def items(doc: Column, path: str) -> Column:
    """Array elements as variants; empty for anything that is not an array."""
    return F.coalesce(
        F.try_variant_get(doc, path, "array<variant>"), F.array().cast("array<variant>")
    )


def instant_ms(value: Column) -> Column:
    """Epoch milliseconds of a real ISO instant with an offset, else null."""
    return F.when(value.rlike(TIMESTAMP), F.unix_millis(F.try_to_timestamp(value)))

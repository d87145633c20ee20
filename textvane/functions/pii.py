"""Ordered redaction of personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textvane.config import PII_PATTERNS

UNICODE = "(?U)"
# A literal every match of the pattern contains: rows without it skip the expression.
REQUIRED_LITERAL = {"ssn": "-", "email": "@"}


def marker(kind: str) -> str:
    return f"[REDACTED_{kind.upper()}]"


def _redact_one(text: Column, kind: str, pattern: str) -> Column:
    redacted = F.regexp_replace(text, UNICODE + pattern, marker(kind))
    needed = REQUIRED_LITERAL.get(kind)
    return F.when(F.contains(text, F.lit(needed)), redacted).otherwise(text) if needed else redacted


def with_redaction(
    df: DataFrame, text: str = "text", redacted: str = "redacted_text", types: str = "pii_detected"
) -> DataFrame:
    """Add the redacted text and the list of types found, in pattern order.

    Each pattern runs once: a type was found iff its step changed the text (a marker never
    equals what it replaces).  Null text gives null and an empty list.
    """
    out = df.withColumn("_pii_0", F.col(text))
    for i, (kind, pattern) in enumerate(PII_PATTERNS, 1):
        out = out.withColumn(f"_pii_{i}", _redact_one(F.col(f"_pii_{i - 1}"), kind, pattern))
    found = [
        F.when(F.col(f"_pii_{i}") != F.col(f"_pii_{i - 1}"), F.lit(kind))
        for i, (kind, _) in enumerate(PII_PATTERNS, 1)
    ]
    last = len(PII_PATTERNS)
    out = out.withColumn(redacted, F.col(f"_pii_{last}")).withColumn(types, F.array_compact(F.array(*found)))
    return out.drop(*[f"_pii_{i}" for i in range(last + 1)])

"""Text expressions: cleaning, normal forms, lengths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from textvane.config import MOJIBAKE_QUOTES

# Unicode white space plus the four ASCII separators that text tools also strip.
BLANK = r"(?U)^[\s\x1c-\x1f]*\z"
EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
CONTROL_AND_RETURN = r"[\x00-\x08\x0B-\x1F]"


def is_blank(text: Column) -> Column:
    """Null, empty, or white space only."""
    return text.isNull() | text.rlike(BLANK)


def strip_controls(text: Column, keep_return: bool = True) -> Column:
    """Drop control characters, keeping newline and tab (and carriage return)."""
    return F.regexp_replace(text, CONTROL if keep_return else CONTROL_AND_RETURN, "")


def collapse_spaces(text: Column) -> Column:
    """One blank between words, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE_RUN, " "))


def repair_quotes(text: Column) -> Column:
    for broken, mended in MOJIBAKE_QUOTES:
        text = F.replace(text, F.lit(broken), F.lit(mended))
    return text


def clean_text(text: Column) -> Column:
    """Controls out, spaces collapsed, quotes repaired; null becomes the empty string."""
    tidy = collapse_spaces(strip_controls(F.coalesce(text, F.lit(""))))
    return F.trim(repair_quotes(tidy))


def clean_basic(text: Column) -> Column:
    """The plain variant: no quote repair, carriage returns removed first."""
    return collapse_spaces(strip_controls(text, keep_return=False))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def normal_form(text: Column) -> Column:
    """Key for case-insensitive exact deduplication."""
    return F.lower(strip(text))


def n_chars(text: Column) -> Column:
    return F.length(text).cast("long")


def n_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("long")

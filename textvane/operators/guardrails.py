"""Checks on predictions: confidence, label, redaction, verdict."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from textvane.config import CONFIDENCE_THRESHOLD, VALID_LABELS
from textvane.functions.pii import with_redaction
from textvane.functions.scores import sql_list


def confidence_flag(confidence: Column, threshold: Column | float = CONFIDENCE_THRESHOLD) -> Column:
    """Flag text below the threshold (strictly), null otherwise."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    message = F.concat(
        F.format_string("LOW_CONFIDENCE: %.3f < ", confidence), limit.cast("double").cast("string")
    )
    return F.when(confidence < limit, message)


def label_flag(label: Column, valid_labels: Sequence[str] = VALID_LABELS) -> Column:
    """Flag text for a label outside the valid set; the set is printed sorted."""
    known = F.coalesce(label.isin(*valid_labels), F.lit(False))
    shown = F.coalesce(label, F.lit("null"))
    return F.when(~known, F.concat(F.lit("INVALID_LABEL: '"), shown, F.lit("' not in " + sql_list(valid_labels))))


def apply_guardrails(
    predictions: DataFrame,
    threshold: Column | float = CONFIDENCE_THRESHOLD,
    valid_labels: Sequence[str] = VALID_LABELS,
    stamp: bool = True,
) -> DataFrame:
    """Redact the text and decide ``passed``: no flags.  Personal data alone does not fail."""
    redacted = with_redaction(predictions)
    flags = F.array_compact(
        F.array(confidence_flag(F.col("confidence"), threshold), label_flag(F.col("label"), valid_labels))
    )
    judged = redacted.withColumn("flags", flags).withColumn("passed", F.size("flags") == 0)
    return judged.withColumn("ts", F.current_timestamp()) if stamp else judged


def pii_type_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per type of personal data (and per grouping column)."""
    # the outer form: a plain explode would have the whole redaction repeated as a filter of the scan
    every = with_redaction(df.select("text", *by)).select(*by, F.explode_outer("pii_detected").alias("pii_type"))
    found = every.where(F.col("pii_type").isNotNull())
    return found.groupBy(*by, "pii_type").agg(F.count(F.lit(1)).alias("n_rows"))

"""Row and request validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textvane.config import CONFIDENCE_THRESHOLD, MAX_REQUEST_CHARS
from textvane.functions.text import is_blank


def blank_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text is null, empty or only white space."""
    return df.where(is_blank(F.col(text)))


def validation_counts(df: DataFrame, text: str = "text") -> DataFrame:
    bad = is_blank(F.col(text))
    return df.agg(F.count_if(~bad).alias("n_valid"), F.count_if(bad).alias("n_failed"))


def request_reasons(text: Column, threshold: Column, max_chars: int = MAX_REQUEST_CHARS) -> Column:
    """Why a scoring request is rejected; an empty array means it is valid."""
    return F.array_compact(
        F.array(
            F.when(text.isNull(), F.lit("text_missing")),
            F.when(F.length(text) < 1, F.lit("text_too_short")),
            F.when(F.length(text) > max_chars, F.lit("text_too_long")),
            F.when(~threshold.between(0.0, 1.0), F.lit("threshold_out_of_range")),
        )
    )


def check_requests(df: DataFrame, default_threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    """Fill the default threshold and add ``reasons`` and ``valid``."""
    filled = df.withColumn(
        "confidence_threshold", F.coalesce(F.col("confidence_threshold"), F.lit(default_threshold))
    )
    checked = filled.withColumn("reasons", request_reasons(F.col("text"), F.col("confidence_threshold")))
    return checked.withColumn("valid", F.size("reasons") == 0)


def split_requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid requests, rejected requests with their reasons)."""
    checked = check_requests(df)
    return checked.where("valid").drop("reasons", "valid"), checked.where("not valid").drop("valid")

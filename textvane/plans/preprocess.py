"""Corpus preparation from raw rows to the sample that is trained on."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, functions as F

from textvane.config import SAMPLE_FRACTION
from textvane.functions.text import clean_basic, clean_text, is_blank
from textvane.operators.dedup import drop_exact_copies, fuzzy_dedup
from textvane.operators.sampling import stratified_fraction, stratified_size
from textvane.sources.corpus import cache_to_disk


def clean_corpus(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, clean_text(F.col(text)))


def preprocess(
    df: DataFrame,
    clean: bool = True,
    deduplicate: bool = True,
    sample_fraction: float | None = None,
    measure=None,
    label: str = "label",
    cache_path: str | None = None,
) -> DataFrame:
    """Clean, drop fuzzy duplicates, optionally sample per label, optionally cache.

    Blank rows are not dropped: they clean to the empty string, and deduplication keeps the
    first of them.  Sampling is skipped for a corpus without labels.
    """
    out = clean_corpus(df) if clean else df
    if deduplicate:
        out = fuzzy_dedup(out, measure)
    if sample_fraction is not None and label in df.columns:
        out = stratified_fraction(out, sample_fraction, label)
    if cache_path is not None:
        cache_to_disk(out, cache_path)
        out = df.sparkSession.read.parquet(cache_path)
    return out


def run_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows processed and filtered."""
    n_in, n_out = before.agg(F.count(F.lit(1))).scalar(), after.agg(F.count(F.lit(1))).scalar()
    return before.sparkSession.range(1).select(
        n_in.alias("records_processed"), (n_in - n_out).alias("records_filtered")
    )


def timed_preprocess(df: DataFrame, path: str, **options) -> DataFrame:
    """Run ``preprocess`` into a table; rows processed and filtered, and the seconds it took."""
    start = time.perf_counter()
    preprocess(df, **options).write.parquet(path)
    spent = time.perf_counter() - start
    return run_stats(df, df.sparkSession.read.parquet(path)).withColumn("elapsed_seconds", F.lit(spent))


def validated_steps(df: DataFrame, sample_size: int | None = None, label: str = "label") -> dict[str, DataFrame]:
    """The stricter chain: drop blanks, drop exact copies, clean, sample by size.

    Labels stay with their row.
    """
    valid = df.where(~is_blank(F.col("text")))
    unique = drop_exact_copies(valid)
    cleaned = unique.withColumn("text", clean_basic(F.col("text")))
    sampled = cleaned
    if sample_size is not None:
        if label in df.columns:
            sampled = stratified_size(cleaned, sample_size, label)
        else:
            sampled = cleaned.orderBy("doc_id").limit(sample_size)
    return {"valid": valid, "unique": unique, "cleaned": cleaned, "sampled": sampled}


def stage_stats(df: DataFrame, sample_size: int | None = None, label: str = "label") -> DataFrame:
    """One row of counts per stage.  Cleaning drops no row, so it is not run for its count."""
    steps = validated_steps(df, sample_size, label)
    n = lambda frame: frame.agg(F.count(F.lit(1))).scalar()
    counts = df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~is_blank(F.col("text"))).alias("after_validation")
    )
    return counts.select(
        "total",
        (F.col("total") - F.col("after_validation")).alias("validation_failures"),
        "after_validation",
        n(steps["unique"]).alias("after_dedup"),
        n(steps["sampled"]).alias("after_sampling"),
    ).select(
        "*",
        (F.col("after_validation") - F.col("after_dedup")).alias("duplicates_removed"),
        F.col("after_dedup").alias("after_cleaning"),
    )

"""Corpus quality: label balance, length statistics, the quality report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from textvane.config import IMBALANCE_THRESHOLD, OUTLIER_PERCENTILE
from textvane.functions.text import is_blank, n_chars
from textvane.scale import lookup_side


def label_counts(df: DataFrame, label: str = "label", order: str = "doc_id") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_id"))


def label_distribution(
    df: DataFrame, label: str = "label", order: str = "doc_id", threshold: float = IMBALANCE_THRESHOLD
) -> DataFrame:
    """One row: number of labels, imbalance ratio, verdict, majority and minority label, rows per label.

    Ties go to the label seen first.  An empty corpus is balanced with ratio 0.
    """
    counts = label_counts(df, label, order)
    summary = counts.agg(
        F.count(F.lit(1)).alias("n_labels"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.max("n").alias("_most"),
        F.min("n").alias("_least"),
        F.max_by(label, F.struct("n", -F.col("first_id"))).alias("max_class"),
        F.min_by(label, F.struct("n", "first_id")).alias("min_class"),
        F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), "n"))).alias("label_counts"),  # one entry per label
    )
    ratio = F.coalesce(F.try_divide(F.col("_most"), F.col("_least")), F.lit(0.0))
    return summary.select(
        "n_labels",
        "n_rows",
        ratio.alias("imbalance_ratio"),
        (ratio <= threshold).alias("is_balanced"),
        "max_class",
        "min_class",
        "label_counts",
    )


def length_stats(df: DataFrame, text: str = "text", percentile: float = OUTLIER_PERCENTILE) -> DataFrame:
    """One row of length statistics; zeros for an empty corpus.

    Everything comes from the histogram of lengths: the shuffle carries one row per distinct
    length per task, and the ordered pass runs over distinct lengths, not over texts.
    """
    histogram = (
        df.where(F.col(text).isNotNull()).groupBy(n_chars(F.col(text)).alias("len")).agg(F.count(F.lit(1)).alias("n"))
    )
    # one row per distinct length, at most the length of the longest text
    upto = Window.orderBy("len").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    ranked = histogram.select(
        "len", "n", F.sum("n").over(upto).alias("cum"), F.sum("n").over(everything).alias("total")
    )
    wanted = F.least((F.col("total") * F.lit(percentile)).cast("long"), F.col("total") - 1)
    above_cut = F.when(F.col("cum") > wanted, F.col("len"))
    above_half = F.when(F.col("cum") > F.floor(F.col("total") / 2), F.col("len"))
    flat = ranked.select("len", "n", "cum", above_cut.alias("c"), above_half.alias("h"))
    zero = F.lit(0)
    stats = flat.agg(
        F.coalesce(F.sum("n"), zero).alias("n_texts"),
        F.coalesce(F.try_divide(F.sum(F.col("len") * F.col("n")), F.sum("n")), F.lit(0.0)).alias("mean_length"),
        F.coalesce(F.min("len"), zero).alias("min_length"),
        F.coalesce(F.max("len"), zero).alias("max_length"),
        F.coalesce(F.min("h"), zero).alias("median_length"),
        F.coalesce(F.min("c"), zero).alias("percentile_length"),
        # rows at or below the cut are those with the smallest running count above it
        F.coalesce(F.sum("n") - F.min(F.when(F.col("c").isNotNull(), F.col("cum"))), zero).alias("outlier_count"),
    )
    return stats


def length_outliers(df: DataFrame, text: str = "text", percentile: float = OUTLIER_PERCENTILE) -> DataFrame:
    """Rows strictly longer than the length percentile."""
    cut = length_stats(df, text, percentile).select("percentile_length").scalar()
    return df.where(n_chars(F.col(text)) > cut)


def blank_section(df: DataFrame, text: str = "text", order: str = "doc_id", sample: int = 10) -> DataFrame:
    bad = is_blank(F.col(text))
    counts = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(bad).alias("n"))
    first = df.where(bad).orderBy(order).limit(sample).agg(F.array_sort(F.collect_list(order)).alias("ids"))
    return counts.select(
        "total",
        "n",
        (F.coalesce(F.try_divide(F.col("n") * 100.0, F.col("total")), F.lit(0.0))).alias("pct"),
        first.scalar().alias("sample_ids"),
    )


def first_groups(groups: DataFrame, k: int = 5) -> DataFrame:
    """(leader_id, n_members) of the ``k`` duplicate groups with the smallest leaders."""
    return groups.groupBy("leader_id").agg(F.count(F.lit(1)).alias("n_members")).orderBy("leader_id").limit(k)


def first_group_members(groups: DataFrame, k: int = 5) -> DataFrame:
    """All (leader_id, member_id) rows of these groups; a group may have any number of members."""
    return groups.join(lookup_side(first_groups(groups, k).select("leader_id"), k), "leader_id").select("leader_id", "member_id")


def quality_report(df: DataFrame, groups: DataFrame, label: str | None = "label") -> DataFrame:
    """One row of nested sections: blanks, duplicates, lengths, labels.

    ``groups`` are (leader_id, member_id) rows of the duplicate detector.
    """
    blank = blank_section(df)
    duplicates = groups.agg(F.count(F.lit(1)).alias("n"))
    sample = first_groups(groups).agg(
        F.array_sort(F.collect_list(F.struct("leader_id", "n_members"))).alias("g")
    )
    lengths = length_stats(df.select("text"))
    labels = label_distribution(df, label) if label else None
    spark = df.sparkSession
    total = blank.select("total").scalar()
    one = spark.range(1).select(
        total.alias("total_records"),
        blank.select(F.struct("n", "pct", "sample_ids")).scalar().alias("empty_or_null"),
        duplicates.scalar().alias("_dups"),
        sample.scalar().alias("_sample"),
        lengths.select(F.struct("*")).scalar().alias("length_distribution"),
        (labels.select(F.struct("*")).scalar() if labels is not None else F.lit(None)).alias("label_distribution"),
    )
    pct = F.coalesce(F.try_divide(F.col("_dups") * 100.0, F.col("total_records")), F.lit(0.0))
    return one.select(
        "total_records",
        "empty_or_null",
        F.struct(F.col("_dups").alias("n"), pct.alias("pct"), F.col("_sample").alias("sample_groups")).alias(
            "duplicates"
        ),
        "length_distribution",
        "label_distribution",
    )

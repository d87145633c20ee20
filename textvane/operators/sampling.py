"""Stratified samples and splits with exact quotas.

A label may hold any share of the corpus, so no label is ever gathered: the quota-th row of
each label is found on the narrow (label, order) columns, and the corpus itself is only
filtered against those few cutoffs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textvane.config import SAMPLE_FRACTION, SPLIT_SEED, TEST_SIZE
from textvane.scale import rank_cutoffs, within_cutoff


def _sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def _head(df: DataFrame, label: str, order: list[str], quotas: DataFrame) -> DataFrame:
    marked = within_cutoff(df, label, order, rank_cutoffs(df, label, order, quotas), "_kept")
    return marked.where("_kept").drop("_kept")


def stratified_fraction(
    df: DataFrame, fraction: float = SAMPLE_FRACTION, label: str = "label", order: str = "doc_id"
) -> DataFrame:
    """Per label the first ``max(1, int(n * fraction))`` rows in id order."""
    quota = F.greatest(F.lit(1), (F.col("n") * F.lit(fraction)).cast("long"))
    return _head(df, label, [order], _sizes(df, label).withColumn("quota", quota))


def stratified_size(df: DataFrame, size: int, label: str = "label", order: str = "doc_id") -> DataFrame:
    """Per label the first ``max(1, int(size * share))`` rows; all rows if size >= n."""
    sizes = _sizes(df, label).withColumn("total", F.sum("n").over(Window.partitionBy()))  # one row per label
    share = (F.lit(size) * (F.col("n") / F.col("total"))).cast("long")
    quota = F.when(F.lit(size) >= F.col("total"), F.col("n")).otherwise(F.greatest(F.lit(1), share))
    return _head(df, label, [order], sizes.withColumn("quota", quota))


def split_quotas(df: DataFrame, label: str = "label", test_size: float = TEST_SIZE) -> DataFrame:
    """Test rows per label: ceil(n * test_size) in all, shared by largest remainder."""
    everything = Window.partitionBy()  # one row per label
    sizes = _sizes(df, label).withColumn("total", F.sum("n").over(everything))
    wanted = F.ceil(F.col("total") * F.lit(test_size))
    exact = F.col("n") * wanted / F.col("total")
    shares = sizes.select(
        label, "n", wanted.alias("wanted"), F.floor(exact).alias("base"), (exact - F.floor(exact)).alias("rest")
    )
    by_rest = Window.orderBy(F.col("rest").desc(), F.col(label))  # one row per label
    return shares.withColumn("missing", F.col("wanted") - F.sum("base").over(everything)).select(
        label,
        "n",
        (F.col("base") + F.when(F.row_number().over(by_rest) <= F.col("missing"), 1).otherwise(0)).alias("quota"),
    )


def shuffle_key(seed: int = SPLIT_SEED, order: str = "doc_id") -> Column:
    return F.xxhash64(F.lit(seed), F.col(order))


def train_test_split(
    df: DataFrame,
    test_size: float = TEST_SIZE,
    seed: int = SPLIT_SEED,
    label: str = "label",
    order: str = "doc_id",
    key: Column | None = None,
) -> DataFrame:
    """Add ``split``: per label the quota of rows with the smallest shuffle key is the test set."""
    keyed = df.withColumn("_key", shuffle_key(seed, order) if key is None else key)
    cutoffs = rank_cutoffs(keyed, label, ["_key", order], split_quotas(df, label, test_size))
    marked = within_cutoff(keyed, label, ["_key", order], cutoffs, "_test")
    return marked.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_key", "_test")


def ratio_comparison(original: DataFrame, sampled: DataFrame, label: str = "label") -> DataFrame:
    """Share of each label before and after (null where it is absent)."""

    def shares(df: DataFrame, name: str) -> DataFrame:
        total = F.sum("n").over(Window.partitionBy())  # one row per label
        return _sizes(df, label).select(label, (F.col("n") / total).alias(name))

    return shares(original, "share_before").join(shares(sampled, "share_after"), label, "full_outer")


def ratio_preserved(
    original: DataFrame, sampled: DataFrame, tolerance: float = 0.1, label: str = "label"
) -> DataFrame:
    """One row: the label sets agree and every share is within the tolerance."""
    both = F.col("share_before").isNotNull() & F.col("share_after").isNotNull()
    close = F.abs(F.col("share_before") - F.col("share_after")) <= tolerance
    return ratio_comparison(original, sampled, label).agg(
        F.coalesce(F.bool_and(F.coalesce(both & close, F.lit(False))), F.lit(True)).alias("preserved")
    )


def label_sets_equal(left: DataFrame, right: DataFrame, label: str = "label") -> DataFrame:
    a, b = left.select(label).distinct(), right.select(label).distinct()
    differing = a.exceptAll(b).unionByName(b.exceptAll(a))
    return differing.agg((F.count(F.lit(1)) == 0).alias("equal"))

"""Fixed-size ordered batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from textvane.config import BATCH_MEMORY_SHARE, DEFAULT_BATCH_SIZE
from textvane.functions.text import n_bytes
from textvane.scale import with_rank


def batch_size_for_budget(df: DataFrame, budget_bytes: int, text: str = "text") -> DataFrame:
    """One row: rows per batch so that a batch uses a tenth of the byte budget."""
    mean = F.avg(n_bytes(F.col(text)))
    fitted = F.greatest(F.lit(1), F.try_divide(F.lit(float(budget_bytes) * BATCH_MEMORY_SHARE), mean).cast("long"))
    return df.agg(
        F.when(mean > 0, fitted).otherwise(F.lit(DEFAULT_BATCH_SIZE)).cast("long").alias("batch_size"),
        mean.alias("mean_bytes"),
    )


def batch_positions(df: DataFrame, size: int = DEFAULT_BATCH_SIZE, order: str = "doc_id") -> DataFrame:
    """(id, batch_id, position in batch) of every row; only ids are moved."""
    if size < 1:
        raise ValueError("a batch holds at least one row")
    ranked = with_rank(df.select(order), [], [order])
    return ranked.select(
        order, F.floor(F.col("_rank") / size).alias("batch_id"), (F.col("_rank") % size).alias("position")
    )


def assign_batches(df: DataFrame, size: int = DEFAULT_BATCH_SIZE, order: str = "doc_id") -> DataFrame:
    """The rows with their batch; labels and other columns travel along."""
    return df.join(batch_positions(df, size, order), order)


def batch_sizes(positions: DataFrame) -> DataFrame:
    return positions.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_rows"))


def iterate_batches(df: DataFrame, size: int = DEFAULT_BATCH_SIZE, order: str = "doc_id") -> Iterator[list]:
    """Feed batches to a local consumer in order, one partition ahead, never all rows at once."""
    ordered = assign_batches(df, size, order).orderBy("batch_id", "position")
    current, rows = None, []
    for row in ordered.toLocalIterator(prefetchPartitions=True):
        if current is not None and row.batch_id != current:
            yield rows
            rows = []
        current = row.batch_id
        rows.append(row)
    if rows:
        yield rows

"""Evaluation of a scoring model on the held-out part of a labelled corpus."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from textvane.operators.evaluation import classification_report, confusion_matrix
from textvane.operators.monitor import linear_percentiles
from textvane.operators.scoring import score_rows, verdicts
from textvane.session import checkpointed


@dataclass(frozen=True)
class HeldOut:
    """Report rows, confusion matrix, and one row of latency statistics with the number of samples."""

    report: DataFrame
    matrix: DataFrame
    latency: DataFrame


def evaluate_held_out(
    split: DataFrame, load_scorer: Callable, part: str = "test", text: str = "text", label: str = "label", order: str = "doc_id"
) -> HeldOut:
    """Score the rows of one part, each as a call of its own, and judge them.

    A failed row is predicted as ``error``, a class of its own.  Only ids, labels and times are kept.
    """
    rows = split.where(F.col("split") == part).select(order, F.col(text).alias("text"), F.col(label).alias("true_label"))
    judged = verdicts(score_rows(rows, load_scorer, timed=True))
    kept = checkpointed(judged.select(order, "true_label", F.col("label").alias("pred_label"), "latency_ms"))
    matrix = confusion_matrix(kept)
    latency = linear_percentiles(kept, "latency_ms").withColumn("total_samples", kept.agg(F.count(F.lit(1))).scalar())
    return HeldOut(classification_report(matrix), matrix, latency)

"""Model evaluation: confusion matrix and the metrics derived from it.

Everything after the confusion counts works on (classes x classes) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textvane.functions.scores import argmax_index, encode_label
from textvane.scale import join_on

UNKNOWN = "unknown"


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def class_labels(df: DataFrame, label: str = "true_label") -> DataFrame:
    """Sorted distinct labels."""
    return df.select(label).distinct().orderBy(label)


def confusion_matrix(df: DataFrame, true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    """(true_label, pred_label, n) for every pair of labels, zeros included.

    A missing text label is the label ``unknown``; a missing label of another type stays null and
    has a row and column of its own.
    """
    named = df.select(F.col(true).alias("true_label"), F.col(pred).alias("pred_label"))
    named = named.select(
        *[F.coalesce(c, F.lit(UNKNOWN)).alias(c) if kind == "string" else F.col(c) for c, kind in named.dtypes]
    )
    counts = named.groupBy("true_label", "pred_label").agg(F.count(F.lit(1)).alias("n"))
    # the label set is as small as the model's output; structs keep a null
    label = F.explode(F.array(F.struct(F.col("true_label").alias("l")), F.struct(F.col("pred_label").alias("l"))))
    labels = counts.select(label.alias("x")).agg(F.array_sort(F.collect_set("x")).alias("xs"))
    grid = labels.select(F.explode("xs").alias("t"), "xs").select("t", F.explode("xs").alias("p"))
    grid = grid.select(F.col("t.l").alias("true_label"), F.col("p.l").alias("pred_label"))
    return join_on(grid, counts, ["true_label", "pred_label"], "left").select(
        "true_label", "pred_label", F.coalesce("n", F.lit(0)).alias("n")
    )


def confusion_table(matrix: DataFrame, labels: list) -> DataFrame:
    """The dense form: one row per true label, one column per predicted label."""
    return matrix.groupBy("true_label").pivot("pred_label", labels).agg(F.first("n"))


def per_class_metrics(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class; a zero denominator gives 0."""
    hit = F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0)
    sides = matrix.select(
        F.explode(
            F.array(
                F.struct(F.col("true_label").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), hit.alias("tp")),
                F.struct(F.col("pred_label").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")),
            )
        ).alias("s")
    )
    margins = sides.groupBy("s.label").agg(
        F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"), F.sum("s.tp").alias("tp")
    )
    return margins.select(
        "label",
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
        "support",
    )


def overall_metrics(matrix: DataFrame, known: list | None = None) -> DataFrame:
    """One row: accuracy and the macro and weighted averages.

    With ``known``, other labels (such as an unknown prediction) are left out of the averages.
    """
    hits = matrix.agg(
        F.sum(F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0)).alias("hits"),
        F.sum("n").alias("rows"),
    )
    classes = per_class_metrics(matrix)
    if known is not None:
        classes = classes.where(F.col("label").isin(*known))
    accuracy = hits.select(_ratio(F.col("hits"), F.col("rows"))).scalar()
    weighted = lambda c: _ratio(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    return classes.agg(
        F.coalesce(F.avg("precision"), F.lit(0.0)).alias("macro_precision"),
        F.coalesce(F.avg("recall"), F.lit(0.0)).alias("macro_recall"),
        F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"),
        weighted("precision").alias("weighted_precision"),
        weighted("recall").alias("weighted_recall"),
        weighted("f1").alias("weighted_f1"),
        F.coalesce(F.sum("support"), F.lit(0)).alias("support"),
    ).select(accuracy.alias("accuracy"), "*")


def classification_report(matrix: DataFrame, known: list | None = None) -> DataFrame:
    """Class rows, then accuracy, macro avg and weighted avg rows."""
    classes = per_class_metrics(matrix).select(
        F.col("label").cast("string").alias("label"), "precision", "recall", "f1", "support"
    )
    summary = overall_metrics(matrix, known).select(
        F.explode(
            F.array(
                F.struct(F.lit("accuracy").alias("label"), F.col("accuracy").alias("precision"), F.col("accuracy").alias("recall"), F.col("accuracy").alias("f1"), "support"),
                F.struct(F.lit("macro avg").alias("label"), F.col("macro_precision").alias("precision"), F.col("macro_recall").alias("recall"), F.col("macro_f1").alias("f1"), "support"),
                F.struct(F.lit("weighted avg").alias("label"), F.col("weighted_precision").alias("precision"), F.col("weighted_recall").alias("recall"), F.col("weighted_f1").alias("f1"), "support"),
            )
        ).alias("s")
    ).select("s.*")
    return classes.unionByName(summary)


def evaluate(df: DataFrame, true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    return overall_metrics(confusion_matrix(df, true, pred))


def metrics_from_logits(df: DataFrame, logits: str = "logits", label_id: str = "label_id") -> DataFrame:
    """Macro F1, accuracy, macro precision and recall of the argmax class."""
    scored = df.select(F.col(label_id).alias("true_label"), argmax_index(F.col(logits)).alias("pred_label"))
    return evaluate(scored).select(
        F.col("macro_f1").alias("f1_macro"),
        "accuracy",
        F.col("macro_precision").alias("precision_macro"),
        F.col("macro_recall").alias("recall_macro"),
    )

"""Training history: evaluation rows of a trainer's JSON state file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

ENTRY = T.StructType(
    [
        T.StructField("step", T.LongType()),
        T.StructField("eval_f1_macro", T.DoubleType()),
        T.StructField("eval_accuracy", T.DoubleType()),
        T.StructField("eval_precision_macro", T.DoubleType()),
        T.StructField("eval_recall_macro", T.DoubleType()),
    ]
)
STATE = T.StructType([T.StructField("log_history", T.ArrayType(ENTRY))])


def load_history(spark: SparkSession, path: str) -> DataFrame:
    states = spark.read.schema(STATE).option("multiLine", True).json(path)
    return states.select(F.explode("log_history").alias("e")).select("e.*")


def best_checkpoint(history: DataFrame, metric: str = "eval_f1_macro") -> DataFrame:
    """The evaluation row with the highest metric, the earliest one on ties."""
    return history.where(F.col(metric).isNotNull()).orderBy(F.col(metric).desc(), F.col("step")).limit(1)

"""Result sinks: metrics, reports, the recovery audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from textvane.sources.corpus import require_columns

AUDIT_ID = ("key", "ts", "event_id", "action_type")
ACTION = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("action_type", T.StringType()),
    ]
)


def write_metrics_json(metrics: DataFrame, path: str) -> str:
    metrics.write.mode("overwrite").json(path)
    return path


def results_table(model: str, overall: DataFrame, per_class: DataFrame | None = None) -> DataFrame:
    """Long (model, metric, class, value) rows of one model's results."""
    names = [f.name for f in overall.schema.fields]
    flat = overall.select(
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
        ).alias("s")
    ).select(F.lit(model).alias("model"), "s.metric", F.lit(None).cast("string").alias("class"), "s.value")
    if per_class is None:
        return flat
    values = [n for n in per_class.columns if n != "label"]
    detail = per_class.select(
        F.col("label").cast("string").alias("class"),
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in values])
        ).alias("s"),
    ).select(F.lit(model).alias("model"), "s.metric", "class", "s.value")
    return flat.unionByName(detail)


def write_results(results: DataFrame, path: str, format: str = "json") -> str:
    if format not in ("json", "parquet"):
        raise ValueError(f"unsupported format: {format}")
    results.write.mode("overwrite").format(format).save(path)
    return path


def model_summary(results: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """One row per model, one column per overall metric."""
    grouped = results.where(F.col("class").isNull()).groupBy("model")
    pivoted = grouped.pivot("metric", metrics) if metrics else grouped.pivot("metric")
    return pivoted.agg(F.first("value"))


# fixed values: the lines of a class in the report
REPORT_LINES = {"precision": "  Precision: %.4f", "recall": "  Recall:    %.4f", "f1": "  F1-Score:  %.4f"}
SUPPORT_LINE = "  Support:   %d"


def _row(title: Column, with_support: Column) -> Column:
    lines = [title, *[F.format_string(shape, F.col(c)) for c, shape in REPORT_LINES.items()]]
    support = F.when(with_support, F.format_string(SUPPORT_LINE, F.col("support")))
    return F.array_compact(F.array(*lines, support))


# fixed values: headings of the averaged sections
SUMMARY_TITLES = {"macro avg": "Macro Average:", "weighted avg": "Weighted Average:"}


def report_lines(report: DataFrame, model: str) -> DataFrame:
    """The classification report as ordered text lines (position, line)."""
    summary = F.col("label").isin(*SUMMARY_TITLES)
    titles = F.create_map(*[F.lit(x) for kv in SUMMARY_TITLES.items() for x in kv])
    title = F.when(summary, F.element_at(titles, F.col("label"))).otherwise(F.concat(F.lit("Class: "), F.col("label")))
    rank = F.when(F.col("label") == "macro avg", 1).when(F.col("label") == "weighted avg", 2).otherwise(0)
    sections = report.where(F.col("label") != "accuracy").select(
        rank.alias("section"), "label", F.posexplode(F.concat(F.array(F.lit("")), _row(title, ~summary))).alias("i", "line")
    )
    head = report.sparkSession.range(1).select(
        F.lit(-1).alias("section"),
        F.lit("").alias("label"),
        F.posexplode(F.array(F.lit(f"Classification Report - {model}"), F.lit("=" * 60), F.lit(""))).alias("i", "line"),
    )
    return head.unionByName(sections).orderBy("section", "label", "i").select("section", "label", "i", "line")


def write_report(report: DataFrame, model: str, path: str) -> str:
    """A report has a handful of lines per class, so one ordered file is written."""
    report_lines(report, model).coalesce(1).select("line").write.mode("overwrite").text(path)
    return path


def append_actions(actions: DataFrame, path: str, part: str | None = None) -> str:
    """Append recovery actions; replays of the same action carry the same id.

    Rows need the columns of ``ACTION``; event_id tells actions of one moment apart and may be missing.
    A named ``part`` is written in full and replaces what an earlier attempt wrote under that name, so a
    micro-batch that is run again adds nothing.
    """
    require_columns(actions, ACTION)
    known = [F.col(c).cast("string").alias(c) for c in AUDIT_ID if c in actions.columns]
    ident = F.sha2(F.to_json(F.struct(*known)), 256)  # a null is left out
    rows = actions.withColumn("action_id", ident)
    if part is None:
        rows.write.mode("append").parquet(path)
    else:
        rows.write.mode("overwrite").parquet(f"{path}/part={part}")
    return path


def read_actions(spark, path: str) -> DataFrame:
    """The audit log with replayed appends collapsed."""
    read = spark.read.parquet(path)
    return read.dropDuplicates(["action_id"]).drop("part")

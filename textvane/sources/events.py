"""Request logs: one contract for batch and streaming readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("key", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("label", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("error", T.BooleanType()),
    ]
)

# fixed values: what a record that omits a field means
DEFAULTS = {"kind": "request", "label": "unknown", "confidence": 0.0, "error": False}
PREDICTION_CONFIDENCE = 1.0

MICRO_BATCH_BYTES = 1 << 30


def with_defaults(df: DataFrame) -> DataFrame:
    """Fill optional fields; columns that are absent altogether are added."""
    have = set(df.columns)
    out = df
    for name, value in DEFAULTS.items():
        fallback = F.lit(value)
        if name == "confidence" and "kind" in have:
            fallback = F.when(F.col("kind") == "prediction", F.lit(PREDICTION_CONFIDENCE)).otherwise(fallback)
        out = out.withColumn(name, F.coalesce(F.col(name), fallback) if name in have else fallback)
    if "key" not in have:
        out = out.withColumn("key", F.lit("all"))
    if dict(df.dtypes).get("ts") == "timestamp_ntz":
        out = out.withColumn("ts", F.col("ts").cast("timestamp"))
    return out


def is_request() -> Column:
    return F.col("kind") == "request"


def is_error() -> Column:
    """A failed request, or an error recorded on its own."""
    return (F.col("kind") == "error") | (is_request() & F.col("error"))


def is_prediction() -> Column:
    """A recorded prediction, or a request that carried its label."""
    return (F.col("kind") == "prediction") | (is_request() & (F.col("label") != DEFAULTS["label"]))


def is_reset() -> Column:
    """An operator's reset: what is known of the key is forgotten."""
    return F.col("kind") == "reset"


def load_events(spark: SparkSession, path: str, format: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.format(format)
    return with_defaults((reader.schema(schema) if schema else reader).load(path))


def stream_files(
    spark: SparkSession, path: str, schema: T.StructType, format: str = "parquet", live: bool = False, **options: str
) -> DataFrame:
    """A table's files as a stream; ``path`` is a file or a folder of files.

    A live log is read in micro-batches of bounded size.  A finished log is one micro-batch: its
    files may come in any order, and rows of a key that arrive in later batches than younger ones
    could not be put in order any more.
    """
    limits = {"maxBytesPerTrigger": str(MICRO_BATCH_BYTES), **options} if live else options
    name = path.rstrip("/")  # as a pattern that matches itself it may be a file, too
    return spark.readStream.schema(schema).format(format).options(**limits).load(f"{name[:-1]}[{name[-1]}]")


def stream_events(
    spark: SparkSession, path: str, schema: T.StructType = EVENTS, format: str = "parquet", live: bool = False, **options: str
) -> DataFrame:
    """The same log as a stream of files."""
    return with_defaults(stream_files(spark, path, schema, format, live, **options))

"""Labelled corpora: reading, schema checks, and the columnar cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

CORPUS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("label", T.StringType()),
    ]
)

FORMATS = ("parquet", "json", "csv", "orc")


def require_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Check an input against its contract: names and types must be there."""
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f.name for f in schema.fields if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"columns missing or of another type: {', '.join(wrong)}")
    return df


def load_corpus(
    spark: SparkSession,
    path: str,
    format: str = "parquet",
    agreement: str | None = None,
    agreement_column: str = "agreement",
    schema: T.StructType | str | None = None,
    **options: str,
) -> DataFrame:
    """Read a labelled corpus, optionally only one annotator-agreement subset.

    The subset filter is a plain predicate, so it reaches the scan (and prunes partitions
    when the corpus is partitioned by agreement).
    """
    if format not in FORMATS:
        raise ValueError(f"unsupported format: {format}")
    reader = spark.read.format(format).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    corpus = reader.load(path)
    return corpus if agreement is None else corpus.where(F.col(agreement_column) == agreement)


def cache_to_disk(df: DataFrame, path: str, format: str = "parquet", partition_by: str | None = None) -> str:
    """Write prepared data to a columnar cache and return its path."""
    if format not in ("parquet", "orc"):
        raise ValueError(f"unsupported format: {format}")
    writer = df.write.mode("overwrite").format(format)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.save(path)
    return path

"""Streams over a finished log give the batch result whatever files the log is in."""

import pytest
from oracle import compare, database
from pyspark.sql import functions as F

from textvane.catalog.registry import catalog
from textvane.streaming import jobs
from textvane.catalog.log_queries import BASELINE, TENANT, RAW_EVENTS
from textvane.catalog.tables import as_events
from textvane.sources.events import stream_files

CATALOG = catalog()
STREAMS = [n for n in CATALOG if n.startswith("stream_")]


@pytest.fixture(scope="module")
def scattered(spark, tmp_path_factory):
    """The smallest tables as folders; the log in eight files, newest first."""
    import os

    source = os.environ.get("TEXTVANE_TESTDATA", "/root/testdata/sf0.001")
    if not os.path.isdir(source):
        pytest.skip("no test tables")
    path = tmp_path_factory.mktemp("scattered")
    spark.read.parquet(f"{source}/documents.parquet").repartition(3).write.parquet(f"{path}/documents.parquet")
    log = spark.read.parquet(f"{source}/events.parquet")
    log.repartitionByRange(8, F.col("ts").desc()).write.parquet(f"{path}/events.parquet")
    return source, str(path)


@pytest.mark.parametrize("name", STREAMS)
def test_folder_equals_file(spark, scattered, name):
    source, path = scattered
    same, message = compare(spark, database(source), CATALOG[name].run, CATALOG[name].sql, path)
    assert same, message


def test_windows_do_not_depend_on_micro_batches(spark, scattered):
    """One file per micro-batch, newest first: nothing is late, open windows are there."""
    def windows(**options):
        raw = stream_files(spark, f"{scattered[1]}/events.parquet", RAW_EVENTS, **options)
        stream = jobs.metric_windows(as_events(raw, TENANT), BASELINE, watermark=None)
        rows = jobs.run_to_latest(stream, ["key", "window_start"]).select("key", "window_start", "request_count", "p99", "kl")
        return sorted(map(tuple, rows.collect()))

    single = windows(maxFilesPerTrigger="1")
    assert single == windows() and sum(r[2] for r in single) == spark.read.parquet(f"{scattered[1]}/events.parquet").count()


def test_latest_latencies_do_not_depend_on_micro_batches(spark, scattered):
    def last(**options):
        raw = stream_files(spark, f"{scattered[1]}/events.parquet", RAW_EVENTS, **options)
        rows = jobs.run_to_table(jobs.latency_stream(as_events(raw, TENANT)))
        best = rows.groupBy("key").agg(F.max_by(F.struct("ts", "event_id", "p50", "p99", "mean"), "n_seen").alias("m"))
        return sorted(map(tuple, best.select("key", "m.*").collect()))

    assert last(maxFilesPerTrigger="1") == last()

"""Null keys, latencies and labels: one rule everywhere, whether or not a key is cut into slices."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from textvane.config import MonitorPolicy, RecoveryPolicy
from textvane.operators import evaluation, monitor, recovery, rolling
from textvane.sources import sinks

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SMALL = MonitorPolicy(latency_samples=20, drift_samples=15, drift_min_samples=10, window_sec=200)
LIMIT = 37
SCHEMA = "event_id long, ts timestamp, key long, kind string, latency_ms double, label string, confidence double, error boolean"


@pytest.fixture(scope="module")
def log(spark):
    """Two thirds of the events have no key; some have no latency."""
    rng, rows, now = random.Random(9), [], START
    for i in range(700):
        now += timedelta(seconds=rng.choice([0, 1, 2, 5, 40]))
        key = None if rng.random() < 0.66 else rng.choice([1, 1 << 60 | 1])
        latency = None if rng.random() < 0.1 else round(rng.expovariate(0.02), 2)
        bad = rng.random() < (0.55 if (i // 60) % 2 else 0.1)
        rows.append((i, now, key, "request", latency, rng.choice(["negative", "positive"]), round(rng.random(), 2), bad))
    return spark.createDataFrame(rows, SCHEMA).persist()


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_breaker_of_a_hot_null_key(log):
    policy = RecoveryPolicy(failure_threshold=3, recovery_timeout_sec=60)
    whole = plain(recovery.circuit_breaker(log, policy=policy))
    assert whole == plain(recovery.circuit_breaker(log, policy=policy, limit=LIMIT))
    assert {r[0] for r in whole} == {None, 1, 1 << 60 | 1} and len(whole) == 700


def test_rolling_percentiles_skip_missing_latencies(log):
    whole = plain(rolling.rolling_percentiles(log, policy=SMALL))
    assert whole == plain(rolling.rolling_percentiles(log, policy=SMALL, limit=LIMIT))
    timed = [r for r in log.collect() if r.latency_ms is not None]
    assert len(whole) == len(timed)
    for key in (None, 1):
        mine = [r.latency_ms for r in sorted(timed, key=lambda r: (r.ts, r.event_id)) if r.key == key][-20:]
        last = max((r for r in whole if r[0] == key), key=lambda r: (r[1], r[2]))
        assert last[6:8] == (min(mine), max(mine)) and last[8] == pytest.approx(np.mean(mine))


def test_other_windows(log):
    for make in (rolling.running_error_rate, rolling.rolling_throughput, rolling.quality_degradation):
        assert plain(make(log)) == plain(make(log, limit=LIMIT))


def test_snapshot_has_the_null_key(log):
    found = {r.key: r for r in monitor.health_snapshot(log, {"negative": 0.5, "positive": 0.5}, ["key"], policy=SMALL).collect()}
    assert set(found) == {None, 1, 1 << 60 | 1}
    assert found[None].latency.p50 > 0 and found[None].throughput_req_sec >= 0
    shares = monitor.label_shares(log, ["key"], SMALL)
    assert {r.key for r in shares.collect()} == set(found)


def test_alerts_of_the_null_key(log):
    running = rolling.running_error_rate(log).where("error_rate > 0.05").count()
    failing = rolling.alerts(log).where("alert_type = 'error_spike'")
    assert failing.count() == running and failing.where("key is null").count() > 0


def test_linear_percentiles(log):
    timed = [r for r in log.collect() if r.latency_ms is not None]
    for limit in (10**6, LIMIT):
        found = {r.key: r for r in monitor.linear_percentiles(log, keys=["key"], limit=limit).collect()}
        for key in (None, 1, 1 << 60 | 1):
            mine = [r.latency_ms for r in timed if r.key == key]
            want = [np.mean(mine), *np.percentile(mine, [50, 95, 99])]
            assert [found[key].mean, found[key].p50, found[key].p95, found[key].p99] == pytest.approx(want)
    empty = log.withColumn("latency_ms", F.lit(None).cast("double"))
    assert {r.p50 for r in monitor.linear_percentiles(empty, keys=["key"]).collect()} == {None}


def test_missing_predictions_lower_accuracy(spark):
    rows = [("a", "a"), ("b", "b"), ("a", None), ("b", None)]
    matrix = evaluation.confusion_matrix(spark.createDataFrame(rows, "true_label string, pred_label string"))
    assert matrix.agg(F.sum("n")).first()[0] == 4
    assert evaluation.overall_metrics(matrix).first().accuracy == 0.5
    numbers = spark.createDataFrame([(1, 1), (2, None)], "true_label int, pred_label int")
    counted = {(r.true_label, r.pred_label): r.n for r in evaluation.confusion_matrix(numbers).collect()}
    assert counted[2, None] == 1 and sum(counted.values()) == 2


def test_actions_of_one_moment_are_kept(spark, tmp_path):
    rows = [("k", START, i, "reload") for i in (1, 2)] + [(None, START, 3, "reload")]
    actions = spark.createDataFrame(rows, "key string, ts timestamp, event_id long, action_type string")
    for _ in range(2):  # a replayed append adds nothing
        sinks.append_actions(actions, str(tmp_path / "log"))
    assert sinks.read_actions(spark, str(tmp_path / "log")).count() == 3

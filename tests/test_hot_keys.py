"""Cutting a hot key into slices must not change any result."""

import random
from datetime import datetime, timedelta, timezone
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from textvane.config import MonitorPolicy, RecoveryPolicy
from textvane.operators import monitor, recovery, rolling
from textvane.scale import carry_sums, last_n, rank_cutoffs, running_sums, sliced, small_or_none, with_rank

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SMALL = MonitorPolicy(latency_samples=20, drift_samples=15, drift_min_samples=10, window_sec=200)
BASELINE = {"negative": 0.4, "positive": 0.6}
LIMIT = 37


@pytest.fixture(scope="module")
def log(spark):
    """900 events, two thirds of them of one key, some at the same moment."""
    rng, rows, now = random.Random(5), [], START
    for i in range(900):
        now += timedelta(seconds=rng.choice([0, 1, 2, 5, 40]))
        key = "hot" if rng.random() < 0.66 else rng.choice("abc")
        label = rng.choice(["negative", "positive", "other", "unknown"])
        bad = rng.random() < (0.55 if (i // 60) % 2 else 0.1)
        rows.append((i, now, key, "request", round(rng.expovariate(0.02), 2), label, round(rng.random(), 2), bad))
    return spark.createDataFrame(
        rows, "event_id long, ts timestamp, key string, kind string, latency_ms double, label string, confidence double, error boolean"
    ).persist()


def rows(df, digits=9):
    def tidy(v):
        return round(v, digits) if isinstance(v, float) else v

    return sorted(tuple(tidy(v) for v in r) for r in df.collect())


@pytest.mark.parametrize(
    "operator",
    [
        lambda e, n: rolling.rolling_percentiles(e, policy=SMALL, limit=n),
        lambda e, n: rolling.rolling_drift(e, BASELINE, policy=SMALL, limit=n),
        lambda e, n: rolling.rolling_throughput(e, policy=SMALL, limit=n),
        lambda e, n: rolling.running_error_rate(e, limit=n),
        lambda e, n: rolling.quality_degradation(e, policy=RecoveryPolicy(quality_baseline=0.55, quality_threshold=0.01), limit=n),
        lambda e, n: rolling.error_spikes(e, policy=RecoveryPolicy(error_rate_samples=30, error_rate_threshold=0.3), limit=n),
        lambda e, n: rolling.alerts(e, BASELINE, policy=SMALL, limit=n),
    ],
    ids=["percentiles", "drift", "throughput", "counters", "quality", "spikes", "alerts"],
)
def test_windows(log, operator):
    whole, cut = rows(operator(log, 10**6)), rows(operator(log, LIMIT))
    assert whole and cut == whole


@pytest.mark.parametrize("timeout", [0.0, 60.0])
@pytest.mark.parametrize("variant,strict", [("standard", False), ("standard", True), ("sticky", False)])
def test_breaker(log, timeout, variant, strict):
    policy = RecoveryPolicy(failure_threshold=3, recovery_timeout_sec=timeout)
    run = lambda n: rows(recovery.circuit_breaker(log, policy, variant=variant, strict=strict, limit=n))
    whole = run(10**6)
    assert {r[3] for r in whole} >= {"closed"} and run(LIMIT) == whole


def test_spikes_and_cooldown(log):
    policy = RecoveryPolicy(spike_samples=4, batch_cooldown_sec=90.0)
    spikes = lambda n: rows(recovery.latency_spikes(log, F.col("latency_ms"), F.lit(15.0), policy, limit=n))
    assert spikes(LIMIT) == spikes(10**6) and any(r[-1] for r in spikes(10**6))
    cuts = lambda n: rows(recovery.batch_reduction(log.where("error"), policy, limit=n))
    assert cuts(LIMIT) == cuts(10**6)


def test_rank_and_running_sums(log):
    ranked = {(r.key, r.event_id): r._rank for r in with_rank(log.select("key", "event_id"), ["key"], ["event_id"]).collect()}
    seen = {}
    for r in sorted(log.collect(), key=lambda r: r.event_id):
        assert ranked[(r.key, r.event_id)] == seen.get(r.key, 0)
        seen[r.key] = seen.get(r.key, 0) + 1
    run = lambda n: rows(running_sums(log.select("key", "event_id"), ["key"], ["event_id"], {"s": F.col("event_id")}, n))
    assert run(LIMIT) == run(10**6)


def test_slices_hold_no_hot_key(log):
    cut = sliced(log, ["key"], ["ts", "event_id"], 10, LIMIT)
    sizes = cut.groupBy("key", "_slice").count().where("_slice > 0 OR key = 'hot'").agg(F.max("count")).first()[0]
    assert sizes <= LIMIT + 10


def test_last_n(log):
    kept = {(r.key, r.event_id) for r in last_n(log, ["key"], ["ts", "event_id"], 7, spread=3).collect()}
    by_key = {}
    for r in sorted(log.collect(), key=lambda r: (r.ts, r.event_id)):
        by_key.setdefault(r.key, []).append(r.event_id)
    assert kept == {(k, i) for k, ids in by_key.items() for i in ids[-7:]}


def test_percentiles_of_many_distinct_values(log):
    some = monitor.linear_percentiles(log, keys=["key"])
    sliced_up = monitor.linear_percentiles(log, keys=["key"], limit=LIMIT)
    assert rows(some, 6) == rows(sliced_up.select(*some.columns), 6)
    overall = monitor.linear_percentiles(log)
    assert rows(overall, 6) == rows(monitor.linear_percentiles(log, limit=LIMIT).select(*overall.columns), 6)


@pytest.mark.parametrize("seed", range(20))
def test_wavelet_matrix(seed):
    rng = np.random.default_rng(seed)
    values = rng.choice([rng.normal(size=5), rng.normal(size=5) * 1e6][seed % 2], size=rng.integers(1, 300))
    start = rng.integers(0, values.size, 200)
    stop = rng.integers(start + 1, values.size + 1)
    k = rng.integers(0, stop - start)
    got = rolling.WaveletMatrix(values).kth(start, stop, k)
    assert got.tolist() == [sorted(values[a:b])[i] for a, b, i in zip(start, stop, k)]
    exact = [float(sum(map(Fraction, values[a:b])) / (b - a)) for a, b in zip(start.tolist(), stop.tolist())]
    assert np.allclose(rolling.window_means(values, start, stop), exact, rtol=1e-13, atol=1e-13)


def test_means_do_not_depend_on_what_stands_before():
    """The same window after other values gives the same bits; huge values too."""
    window = np.array([0.1, 0.2, 0.3, 1e9, 7e-9])
    for before in ([], [1e12, 3.3], [5.5] * 100):
        values = np.array([*before, *window])
        mean = rolling.window_means(values, np.array([len(before)]), np.array([values.size]))[0]
        assert mean == rolling.window_means(window, np.array([0]), np.array([5]))[0]
    assert rolling.window_means(np.array([1e300, 1.0]), np.array([0, 1]), np.array([1, 2])).tolist() == [1e300, 1.0]


def test_broadcasts_are_checked_by_rows_and_bytes(spark):
    wide = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("s"))
    assert small_or_none(wide, 10, 20_000).count() == 10
    assert small_or_none(wide, 10, 5_000) is None and small_or_none(wide, 9, 20_000) is None
    assert small_or_none(spark.range(10), 10).count() == 10 and small_or_none(spark.range(10), 9) is None


def test_percentiles_hold_no_whole_slice(spark, monkeypatch):
    """A slice longer than what is answered at once is walked in stretches; the windows stay the same."""
    rng = random.Random(12)
    sent = [(i, START + timedelta(seconds=i), rng.choice(["a", "b", "b", "b", None]), "request", rng.random() * 100) for i in range(1500)]
    many = spark.createDataFrame(sent, "event_id long, ts timestamp, key string, kind string, latency_ms double")
    whole = rolling.rolling_percentiles(many, policy=SMALL).collect()
    plain, most = rolling.WaveletMatrix, 50 + 20 + SMALL.latency_samples

    def bounded(values):
        assert values.size <= most
        return plain(values)

    monkeypatch.setattr(rolling, "WaveletMatrix", bounded)
    monkeypatch.setattr(rolling, "ROWS_AT_ONCE", 50)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        found = rolling.rolling_percentiles(many, policy=SMALL).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(repr, found)) == sorted(map(repr, whole))

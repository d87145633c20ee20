"""Folds over micro-batches equal the batch operators, whatever the cuts; their state ends."""

import random
import shutil
import time
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from textvane.config import MonitorPolicy, RecoveryPolicy
from textvane.operators import recovery, rolling
from textvane.operators.batching import batch_positions
from textvane.sources import sinks
from textvane.sources.events import EVENTS, stream_events, stream_files
from textvane.streaming import folds, jobs

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
LIMIT = 41
POLICY = RecoveryPolicy(
    failure_threshold=3, recovery_timeout_sec=60.0, spike_samples=4, batch_cooldown_sec=90.0, quality_baseline=0.55,
    quality_threshold=0.01, error_rate_samples=30, error_rate_threshold=0.3,
)


@pytest.fixture(scope="module")
def log_rows():
    """1,000 events, two thirds under one key, resets among them, null keys too."""
    rng, rows, now = random.Random(11), [], START
    for i in range(1000):
        now += timedelta(seconds=rng.choice([0, 1, 2, 5, 40, 40, 400]))
        key = "hot" if rng.random() < 0.66 else rng.choice(["a", "b", "c", None])
        kind = "reset" if rng.random() < 0.02 else "request"
        bad = rng.random() < (0.55 if (i // 60) % 2 else 0.1)
        rows.append((i, now, key, kind, round(rng.expovariate(0.02), 2), rng.choice(["x", "y", "unknown"]), round(rng.random(), 2), bad))
    return rows


@pytest.fixture(scope="module")
def log(spark, log_rows):
    return spark.createDataFrame(log_rows, EVENTS).persist()


def streamed(spark, folder, pieces, schema=EVENTS):
    """The pieces as files in order of arrival, one micro-batch each."""
    for i, piece in enumerate(pieces):
        part = f"{folder}/part{i}"
        spark.createDataFrame(piece, schema).coalesce(1).write.parquet(part)
        (file,) = Path(part).glob("*.parquet")
        Path(f"{folder}/log").mkdir(exist_ok=True)
        shutil.copyfile(file, f"{folder}/log/{i}.parquet")
        time.sleep(0.02)  # the source takes files in order of their times
    if schema is EVENTS:
        return stream_events(spark, f"{folder}/log", schema, maxFilesPerTrigger="1")
    return stream_files(spark, f"{folder}/log", schema, maxFilesPerTrigger="1")


def cut(rows, at):
    return [rows[a:b] for a, b in zip([0, *at], [*at, len(rows)])]


def rows(df, digits=9):
    return sorted((tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


CASES = {
    "breaker": (
        lambda s, **o: recovery.gated(jobs.breaker_stream(s, POLICY, **o).rows),
        lambda b, n: recovery.circuit_breaker(b, POLICY, limit=n),
    ),
    "idle": (
        lambda s, **o: recovery.gated(jobs.breaker_stream(s, POLICY, idle_sec=100.0, **o).rows),
        lambda b, n: recovery.circuit_breaker(b, POLICY, idle_sec=100.0, limit=n),
    ),
    "spikes": (
        lambda s, **o: recovery.counted_spikes(jobs.spike_stream(s, F.col("latency_ms"), F.lit(15.0), POLICY, **o).rows, POLICY),
        lambda b, n: recovery.latency_spikes(b, F.col("latency_ms"), F.lit(15.0), POLICY, limit=n),
    ),
    "cooldown": (
        lambda s, **o: recovery.reduced(jobs.cooldown_stream(s.where("error or kind = 'reset'"), POLICY, **o).rows, POLICY),
        lambda b, n: recovery.batch_reduction(b.where("error or kind = 'reset'"), POLICY, limit=n),
    ),
    "quality": (
        lambda s, **o: jobs.quality_stream(s, POLICY, **o).rows,
        lambda b, n: rolling.quality_degradation(b, policy=POLICY, limit=n),
    ),
    "errors": (
        lambda s, **o: jobs.error_spike_stream(s, POLICY, **o).rows,
        lambda b, n: rolling.error_spikes(b, policy=POLICY, limit=n),
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_stream_equals_batch(spark, log, log_rows, tmp_path, name):
    stream, batch = CASES[name]
    want = rows(batch(log, 10**6))
    source = streamed(spark, tmp_path, cut(log_rows, [3, 400, 430]))
    assert want and rows(stream(source, limit=LIMIT)) == want
    assert rows(batch(log, LIMIT)) == want


def test_reset_closes_the_breaker(spark, log_rows):
    """Also between slices of a hot key: compared with a walk event by event."""
    machine = recovery.breaker_machine(POLICY)
    state, want = {}, []
    for i, ts, key, kind, _, _, _, bad in log_rows:
        code, until = state.get(key, (0, 0))
        before = machine.name(code)
        if kind == "reset":
            ok, code, until = True, 0, 0
        else:
            ok, code, until = machine.advance(code, until, round(ts.timestamp() * 1e6), int(bad))
        state[key] = code, until
        want.append((key, i, before, ok, machine.name(code)))
    got = recovery.circuit_breaker(spark.createDataFrame(log_rows, EVENTS), POLICY, limit=7)
    assert rows(got.drop("ts")) == sorted(want, key=repr)
    assert {w[4] for w in want} == {"closed", "open", "half_open"}


def test_reset_brings_the_batch_size_back(spark):
    event = lambda i, kind: (i, START + timedelta(seconds=100 * i), "k", kind, 1.0, "x", 0.5, kind == "request")
    kinds = ["request"] * 3 + ["reset"] + ["request"] * 2
    found = recovery.batch_reduction(spark.createDataFrame([event(i, k) for i, k in enumerate(kinds)], EVENTS), POLICY)
    assert [(r.event_id, r.old_batch_size, r.new_batch_size) for r in found.orderBy("event_id").collect()] == [
        (0, 32, 16), (1, 16, 8), (2, 8, 4), (4, 32, 16), (5, 16, 8),
    ]


def test_late_and_repeated_events_change_nothing(spark, log, log_rows, tmp_path):
    pieces = cut(log_rows, [500, 900])
    again = [*pieces[2], *pieces[0][490:], (5000, START, "hot", "request", 1.0, "x", 0.5, True)]
    folded = jobs.breaker_stream(streamed(spark, tmp_path, [pieces[0], pieces[1], again]), POLICY, limit=LIMIT)
    assert rows(recovery.gated(folded.rows)) == rows(recovery.circuit_breaker(log, POLICY))
    assert sorted(r.event_id for r in folded.late.collect()) == [*range(490, 500), 5000]


def test_state_ends(spark, tmp_path):
    """Keys idle beyond the limit leave the state; a returning key starts anew; what is too old is late."""
    at = lambda sec: START + timedelta(seconds=sec)
    event = lambda i, sec, key: (i, at(sec), key, "request", 1.0, "x", 0.1, True)
    first = [event(i, i, f"k{i}") for i in range(50)] + [event(50, 50, "back")]
    second = [event(100, 300, "new")]
    third = [event(200, 330, "back"), event(201, 331, "back"), event(202, 100, "old")]
    source = streamed(spark, tmp_path, [first, second, third])
    folded = jobs.breaker_stream(source, POLICY, idle_sec=100.0, delay_sec=20.0)
    assert {r.key for r in folded.state.collect()} == {"new", "back"}
    assert [r.event_id for r in folded.late.collect()] == [202]
    kept = spark.createDataFrame([*first, *second, *third[:2]], EVENTS)
    assert rows(recovery.gated(folded.rows)) == rows(recovery.circuit_breaker(kept, POLICY, idle_sec=100.0))


def test_windows_end(spark, tmp_path):
    event = lambda i, sec, key: (i, START + timedelta(seconds=sec), key, "request", 1.0, "x", 0.1, True)
    first = [event(i, i, "early") for i in range(20)]
    second = [event(100 + i, 500 + i, "later") for i in range(20)]
    folded = jobs.quality_stream(streamed(spark, tmp_path, [first, second]), idle_sec=60.0)
    assert sorted((r.key, r.event_id) for r in folded.state.collect()) == [("later", 111 + i) for i in range(9)]


def test_a_repeated_micro_batch_counts_once(spark, log, log_rows, tmp_path):
    """The commit of the last micro-batch is lost, so the next start runs it again."""
    source = streamed(spark, tmp_path, cut(log_rows, [300, 700]))
    path, audit = str(tmp_path / "fold"), str(tmp_path / "audit")
    sink = lambda part, number: sinks.append_actions(
        recovery.recovery_actions(quality=part, policy=POLICY), audit, f"quality-{number}"
    )
    before = jobs.quality_stream(source, POLICY, path=path, sink=sink)
    held, said = rows(before.rows), spark.read.parquet(audit).count()
    for file in Path(f"{path}/progress/commits").iterdir():
        if "2" in file.name:
            file.unlink()
    after = jobs.quality_stream(source, POLICY, path=path, sink=sink)
    assert rows(after.rows) == held == rows(rolling.quality_degradation(log, policy=POLICY))
    assert spark.read.parquet(audit).count() == said == len(held)
    assert sinks.read_actions(spark, audit).count() == said


def test_audit_stream_equals_batch(spark, log, log_rows, tmp_path):
    log = log.where("kind = 'request'")
    source = streamed(spark, tmp_path, cut([r for r in log_rows if r[3] == "request"], [200, 600]))
    said = jobs.audit_stream(source, 15.0, str(tmp_path / "audit"), POLICY, limit=LIMIT)
    want = recovery.detect_all(log, 15.0, POLICY)
    pick = ["key", "ts", "event_id", "action_type", "reason", "success"]
    assert rows(said.select(*pick)) == rows(want.select(*pick))


def test_batches_over_three_micro_batches(spark, tmp_path):
    ids = [(i * 3,) for i in range(200)]
    late = [(10,), (None,)]
    source = streamed(spark, tmp_path, [ids[:50], ids[50:51], [*ids[51:], *late]], "doc_id long")
    folded = folds.batched_stream(source, 32)
    assert rows(folded.rows) == rows(batch_positions(spark.createDataFrame(ids, "doc_id long"), 32))
    assert sorted((r.doc_id for r in folded.late.collect()), key=repr) == [10, None]


def test_exact_windows(spark, log_rows, tmp_path):
    """Percentiles of every window by rank, in any number of micro-batches, newest first."""
    source = streamed(spark, tmp_path, cut(log_rows, [100, 500])[::-1])
    found = jobs.exact_metric_windows(source, {"x": 0.5, "y": 0.5}, "2 hours", policy=MonitorPolicy(drift_min_samples=3), limit=LIMIT)
    groups = {}
    for _, ts, key, kind, latency, *_ in log_rows:
        if kind == "request":
            hour = int(ts.timestamp()) // 7200 * 7200
            groups.setdefault((key, hour), []).append(latency)
    got = {(r.key, int(r.window_start.replace(tzinfo=timezone.utc).timestamp())): r for r in found.where("request_count > 0").collect()}
    assert got.keys() == groups.keys()
    for place, values in groups.items():
        values.sort()
        r = got[place]
        assert (r.p50, r.p95, r.p99) == tuple(values[min(int(len(values) * p / 100), len(values) - 1)] for p in (50, 95, 99))
        assert abs(r.latency_mean - sum(values) / len(values)) < 1e-9 and r.request_count == len(values)

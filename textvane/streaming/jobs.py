"""Structured Streaming forms of the guardrail, metric and fault operators.

Sources are file streams and sinks are tables on shared storage.  Every query keeps its
progress in the shared checkpoint folder unless it is told where.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textvane.config import CONFIDENCE_THRESHOLD, ROWS_PER_SLICE, MonitorPolicy, RecoveryPolicy
from textvane.functions.records import utc_iso_now
from textvane.operators.guardrails import apply_guardrails
from textvane.operators.monitor import error_rate_expr, health_score, kl_terms, nearest_ranks
from textvane.operators.recovery import (
    breaker_machine, cooldown_machine, counted_spikes, forgetting, is_overflow, recovery_actions, reduced, resets, spike_machine,
)
from textvane.operators.rolling import error_spikes, quality_degradation
from textvane.scale import join_on, keys_as_text, keys_as_were, lookup_side
from textvane.session import scratch_path
from textvane.sources.events import is_error, is_prediction, is_request, is_reset
from textvane.sources.sinks import append_actions, read_actions
from textvane.streaming.folds import Folded, replayed_stream, windowed_counts, windowed_stream

MONITOR = MonitorPolicy()
RECOVERY = RecoveryPolicy()
WATERMARK = "10 minutes"
KEYS = ("key",)


def run_to_table(
    stream: DataFrame, path: str | None = None, progress: str | None = None, mode: str = "append"
) -> DataFrame:
    """Process everything available now into a parquet table and read it back."""
    spark = stream.sparkSession
    target = path or scratch_path(spark, "stream-table")
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", target)
        .option("checkpointLocation", progress or scratch_path(spark, "stream-progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def run_to_latest(stream: DataFrame, keys: Sequence[str], path: str | None = None, progress: str | None = None) -> DataFrame:
    """Process a finished log and keep the last state of every group, open windows included.

    Each micro-batch writes the groups it changed; without a watermark no row is late, so the
    result does not depend on how the files fell into micro-batches.
    """
    spark = stream.sparkSession
    target = path or scratch_path(spark, "stream-table")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/part={number}")

    query = (
        stream.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", progress or scratch_path(spark, "stream-progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.LongType())])
    versions = spark.read.schema(schema).parquet(f"{target}/part=*")
    newest = F.max_by(F.struct(*stream.columns), "_batch").alias("_row")
    return versions.groupBy(*keys).agg(newest).select("_row.*")


def guardrail_stream(predictions: DataFrame, threshold: float = CONFIDENCE_THRESHOLD, stamp: bool = True) -> DataFrame:
    """Guardrails on a stream of predictions; stateless, so the batch expressions are reused."""
    return apply_guardrails(predictions, threshold, stamp=stamp)


def _window_counts(baseline: dict[str, float]) -> list[Column]:
    """Aggregates of a window that add up; the counts per class follow the baseline's order."""
    latency = F.when(is_request(), F.col("latency_ms"))
    predicted = [F.count_if(is_prediction() & (F.col("label") == label)) for label in baseline]
    return [
        F.count_if(is_request()).alias("request_count"),
        F.count_if(is_error()).alias("error_count"),
        F.count_if(is_prediction()).alias("n_predictions"),
        F.min(latency).alias("latency_min"),
        F.max(latency).alias("latency_max"),
        F.sum(latency).alias("_sum"),
        F.count(latency).alias("_n_timed"),
        *[n.alias(f"_n_{i}") for i, n in enumerate(predicted)],
    ]


def _window_measures(grouped: DataFrame, baseline: dict[str, float], keys: Sequence[str], policy: MonitorPolicy) -> DataFrame:
    """Rates, drift and health of windows with their counts, a window ``w`` and percentiles."""
    shares = {label: F.col(f"_n_{i}") / F.col("n_predictions") for i, label in enumerate(baseline)}
    enough = (F.col("n_predictions") >= policy.drift_min_samples) & F.lit(bool(baseline))
    kl = F.when(enough, kl_terms(shares, baseline, policy)).otherwise(F.lit(0.0))
    seconds = F.unix_timestamp(F.col("w.end")) - F.unix_timestamp(F.col("w.start"))
    measured = grouped.select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        *keys,
        "request_count",
        "error_count",
        error_rate_expr(F.col("error_count"), F.col("request_count")).alias("error_rate"),
        (F.col("request_count") / seconds).alias("throughput_req_sec"),
        "p50",
        "p95",
        "p99",
        "latency_min",
        "latency_max",
        F.try_divide("_sum", "_n_timed").alias("latency_mean"),
        kl.alias("kl"),
    )
    tail = F.coalesce("p99", F.lit(0.0))
    return measured.select(
        "*",
        (F.col("kl") > policy.drift_threshold).alias("drift_detected"),
        health_score(F.col("error_rate"), tail, F.col("throughput_req_sec")).alias("health_score"),
    )


def metric_windows(
    events: DataFrame,
    baseline: dict[str, float],
    width: str = "1 hour",
    slide: str | None = None,
    keys: Sequence[str] = KEYS,
    watermark: str | None = WATERMARK,
    policy: MonitorPolicy = MONITOR,
    accuracy: int = 10_000,
) -> DataFrame:
    """Per window and key: counts, error rate, throughput, percentiles, drift, health.

    A window of a hot key may hold any number of requests, so its percentiles come from the
    mergeable quantile summary, which is exact up to ``n / accuracy`` ranks; ``exact_metric_windows``
    keeps the counted latencies instead.
    """
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    latency = F.when(is_request(), F.col("latency_ms"))
    points = F.percentile_approx(latency, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), F.lit(accuracy))
    timed = events.withWatermark("ts", watermark) if watermark else events  # None: a finished log
    grouped = timed.groupBy(span.alias("w"), *keys).agg(points.alias("_p"), *_window_counts(baseline))
    named = grouped.select("*", *[F.col("_p")[i].alias(p) for i, p in enumerate(("p50", "p95", "p99"))])
    return _window_measures(named, baseline, keys, policy)


def exact_metric_windows(
    events: DataFrame,
    baseline: dict[str, float],
    width: str = "1 hour",
    slide: str | None = None,
    keys: Sequence[str] = KEYS,
    policy: MonitorPolicy = MONITOR,
    path: str | None = None,
    limit: int = ROWS_PER_SLICE,
) -> DataFrame:
    """The same over everything a stream has available, with exact nearest-rank percentiles.

    Every micro-batch writes its windows' counts and its distinct latencies with their counts; the
    windows are closed by adding them up.  Open windows are there too, and no row is late.
    """
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    groups = ["w", *keys]
    timed = is_request() & F.col("latency_ms").isNotNull() & ~F.isnan("latency_ms")

    def partial(rows: DataFrame) -> DataFrame:
        return rows.groupBy(span.alias("w"), *keys).agg(*_window_counts(baseline))

    def values(rows: DataFrame) -> DataFrame:
        return rows.where(timed).groupBy(span.alias("w"), *keys, "latency_ms").agg(F.count(F.lit(1)).alias("n"))

    parts, counted = windowed_counts(events, partial, values, path)
    add = {"latency_min": F.min, "latency_max": F.max}
    sums = [add.get(c, F.sum)(c).alias(c) for c in parts.columns if c not in groups]
    merged = parts.groupBy(*groups).agg(*sums)
    ranks = nearest_ranks(counted.groupBy(*groups, "latency_ms").agg(F.sum("n").alias("n")), "latency_ms", groups, limit=limit)
    return _window_measures(join_on(merged, ranks, groups, "left"), baseline, keys, policy)


def drift_windows(
    events: DataFrame, baseline: DataFrame, width: str = "1 hour", watermark: str | None = WATERMARK
) -> DataFrame:
    """Label counts per window against a persisted baseline table (stream-static join).

    Labels outside the baseline still count towards the total.  Turn the counts into a
    divergence with ``window_drift``.
    """
    known = lookup_side(baseline)  # one row per class
    counted = events.where(is_prediction())
    counted = counted.withWatermark("ts", watermark) if watermark else counted
    joined = counted.join(known, "label", "left")
    return (
        joined.groupBy(F.window("ts", width).alias("w"), "label", "p")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "label", "p", "n")
    )


def window_drift(counts: DataFrame, baseline: DataFrame, policy: MonitorPolicy = MONITOR) -> DataFrame:
    """Divergence per window from the counts table that ``drift_windows`` appends to."""
    totals = counts.groupBy("window_start", "window_end").agg(
        F.sum("n").alias("total"),
        F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("by_label"),  # one entry per class
    )
    floor = F.lit(policy.drift_floor)
    classes = baseline.where("p > 0").agg(F.array_sort(F.collect_list(F.struct("label", "p"))))
    rows = totals.withColumn("base", classes.scalar()).select("*", F.explode("base").alias("b"))
    share = F.coalesce(F.element_at("by_label", F.col("b.label")) / F.col("total"), floor)
    term = F.col("b.p") * F.log(F.col("b.p") / F.greatest(share, floor))
    summed = rows.groupBy("window_start", "window_end", "total").agg(F.sum(term).alias("_kl"))
    kl = F.when(F.col("total") >= policy.drift_min_samples, F.col("_kl")).otherwise(F.lit(0.0))
    return summed.select(
        "window_start", "window_end", F.col("total").alias("n_predictions"), kl.alias("kl"),
        (kl > policy.drift_threshold).alias("drift_detected"),
    )


def breaker_stream(
    events: DataFrame, policy: RecoveryPolicy = RECOVERY, variant: str = "standard", strict: bool = False,
    keys: Sequence[str] = KEYS, idle_sec: float | None = None, **options,
) -> Folded:
    """Circuit breaker over a stream; ``recovery.gated`` reads its rows.  ``options`` as in ``replayed_stream``."""
    machine = forgetting(breaker_machine(policy, variant, strict), idle_sec)
    return replayed_stream(events, machine, is_error(), keys, is_reset(), **options)


def spike_stream(
    samples: DataFrame, p99: Column, baseline_p95: Column, policy: RecoveryPolicy = RECOVERY, keys: Sequence[str] = KEYS,
    idle_sec: float | None = None, **options,
) -> Folded:
    """Persistent latency spikes over a stream; ``recovery.counted_spikes`` reads its rows."""
    machine = forgetting(spike_machine(policy.spike_samples), idle_sec)
    return replayed_stream(samples, machine, p99 > baseline_p95 * policy.spike_multiplier, keys, resets(samples), **options)


def cooldown_stream(
    overflows: DataFrame, policy: RecoveryPolicy = RECOVERY, keys: Sequence[str] = KEYS, **options
) -> Folded:
    """Accepted overflows over a stream; ``recovery.reduced`` reads its rows."""
    return replayed_stream(overflows, cooldown_machine(policy.batch_cooldown_sec), is_overflow(overflows), keys, **options)


def quality_stream(events: DataFrame, policy: RecoveryPolicy = RECOVERY, keys: Sequence[str] = KEYS, **options) -> Folded:
    """Confidence-degradation alerts; the state is the last few predictions of each key.

    ``options`` as in ``windowed_stream``.
    """
    limit = options.get("limit", ROWS_PER_SLICE)
    chosen = events.where(is_prediction()).select(*keys, "ts", "event_id", "kind", "label", "confidence")
    alerts = lambda rows: quality_degradation(rows, keys, policy, limit)
    return windowed_stream(chosen, alerts, policy.quality_samples - 1, keys, **options)


def error_spike_stream(events: DataFrame, policy: RecoveryPolicy = RECOVERY, keys: Sequence[str] = KEYS, **options) -> Folded:
    """Too many errors among the last N events; the state is those events."""
    limit = options.get("limit", ROWS_PER_SLICE)
    slim = events.select(*keys, "ts", "event_id", "kind", "error")
    return windowed_stream(slim, lambda rows: error_spikes(rows, keys, policy, limit), policy.error_rate_samples - 1, keys, **options)


def audit_stream(
    events: DataFrame, baseline_p95: float, path: str, policy: RecoveryPolicy = RECOVERY, keys: Sequence[str] = KEYS,
    limit: int = ROWS_PER_SLICE,
) -> DataFrame:
    """All detectors' actions appended to the audit log ``path`` while the log streams by; the log read back.

    Each detector writes a part per micro-batch, in full or again, so a repeated micro-batch adds nothing.
    """
    requests = events.where(is_request())
    # (name, stream, actions of its rows)
    quality = lambda rows: recovery_actions(quality=rows, policy=policy)
    spikes = lambda rows: recovery_actions(spikes=counted_spikes(rows, policy, keys), policy=policy)
    cuts = lambda rows: recovery_actions(reductions=reduced(rows, policy, keys), policy=policy)
    sink = lambda name, actions: lambda rows, number: append_actions(actions(rows), path, f"{name}-{number}")
    quality_stream(events, policy, keys, sink=sink("quality", quality), path=f"{path}-quality", limit=limit)
    latency, usual = F.col("latency_ms"), F.lit(baseline_p95)
    spike_stream(requests, latency, usual, policy, keys, sink=sink("spikes", spikes), path=f"{path}-spikes", limit=limit)
    folded = cooldown_stream(events.where(is_error()), policy, keys, path=f"{path}-cooldown", limit=limit)
    append_actions(cuts(folded.rows), path, "cooldown")  # a size follows from all cuts before it; they are few
    return read_actions(events.sparkSession, path)


def latency_stream(events: DataFrame, policy: MonitorPolicy = MONITOR, key: str = "key") -> DataFrame:
    """Percentiles of the last N latencies of each key, one row per key and micro-batch.

    State per key is at most N latencies with their places in the log, so requests may arrive in
    any order; of a key's rows the one with the largest ``n_seen`` is the last word.
    """
    n = policy.latency_samples
    timed = is_request() & F.col("latency_ms").isNotNull() & ~F.isnan("latency_ms")
    source = keys_as_text(events.where(timed).select(key, "ts", "event_id", "latency_ms"), [key])
    source = source.withColumn("_us", F.unix_micros("ts"))
    names = ("p50", "p95", "p99", "min", "max", "mean")
    kept = [source.schema[c] for c in (key, "ts", "event_id")]
    out = T.StructType([*kept, *[T.StructField(m, T.DoubleType()) for m in names], T.StructField("n_seen", T.LongType())])
    state_type = T.StructType(
        [
            T.StructField("us", T.ArrayType(T.LongType())),
            T.StructField("ids", T.ArrayType(T.LongType())),
            T.StructField("values", T.ArrayType(T.DoubleType())),
            T.StructField("seen", T.LongType()),
        ]
    )

    def step(ident: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        us, ids, values, seen = state.get if state.exists else ([], [], [], 0)
        held = pd.DataFrame({"_us": us, "event_id": ids, "latency_ms": values})
        last = None
        for frame in frames:
            seen += len(frame)
            held = pd.concat([held, frame[["_us", "event_id", "latency_ms"]]]) if len(held) else frame[["_us", "event_id", "latency_ms"]]
            held = held.sort_values(["_us", "event_id"]).tail(n)
            last = frame.tail(1) if last is None else last
        recent = [float(x) for x in held["latency_ms"]]
        moments = [int(x) for x in held["_us"]]
        state.update((moments, [int(x) for x in held["event_id"]], recent, seen))
        ordered = sorted(recent)
        at = [ordered[min(int(len(ordered) * p / 100.0), len(ordered) - 1)] for p in (50, 95, 99)]
        row = last[[key, "ts", "event_id"]].copy()
        row["ts"], row["event_id"] = pd.to_datetime(moments[-1], unit="us"), int(held["event_id"].iloc[-1])
        for name, value in zip(names, (*at, ordered[0], ordered[-1], math.fsum(recent) / len(recent))):
            row[name] = value
        row["n_seen"] = seen
        yield row

    stepped = source.groupBy(key).applyInPandasWithState(step, out, state_type, "append", GroupStateTimeout.NoTimeout)
    return keys_as_were(stepped, [key], events)


def alert_stream(events: DataFrame, policy: MonitorPolicy = MONITOR, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, ts, event_id, alert_type, value, raised_at) of requests slower than the alert allows."""
    slow = events.where(is_request() & (F.col("latency_ms") > policy.latency_alert_ms))
    return slow.select(
        *keys, "ts", "event_id", F.lit("latency_spike").alias("alert_type"), F.col("latency_ms").alias("value"), utc_iso_now().alias("raised_at")
    )


def on_alerts(alerts: DataFrame, handler: Callable[[DataFrame, int], None], progress: str | None = None):
    """Hand each micro-batch of alert rows to a user function (a hook); a started query comes back.

    A micro-batch that is run again reaches the handler again, with the same number.
    """
    spark: SparkSession = alerts.sparkSession
    return (
        alerts.writeStream.foreachBatch(handler)
        .option("checkpointLocation", progress or scratch_path(spark, "stream-progress"))
        .trigger(availableNow=True)
        .start()
    )

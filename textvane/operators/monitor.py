"""Request-log metrics: snapshots per key or over the whole log.

``keys`` lists the key columns; an empty list gives one row for the log.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from textvane.config import LATENCY_PROBE_ROWS, ROWS_PER_SLICE, MonitorPolicy
from textvane.functions.records import micros
from textvane.functions.scores import clamp, nearest_rank
from textvane.scale import join_on, last_n, lookup_side, running_sums
from textvane.sources.events import is_error, is_prediction, is_request

POLICY = MonitorPolicy()
RECENT = ("ts", "event_id")


def _grouped(df: DataFrame, keys: Sequence[str]):
    return df.groupBy(*keys) if keys else df.groupBy()


def latency_percentiles(
    events: DataFrame, keys: Sequence[str] = (), policy: MonitorPolicy = POLICY
) -> DataFrame:
    """Nearest-rank p50/p95/p99, min, max, mean of the last N request latencies."""
    timed = is_request() & F.col("latency_ms").isNotNull() & ~F.isnan("latency_ms")
    requests = events.where(timed).select(*keys, *RECENT, "latency_ms")
    recent = last_n(requests, keys, RECENT, policy.latency_samples)
    # at most latency_samples values per key
    samples = _grouped(recent, keys).agg(F.array_sort(F.collect_list("latency_ms")).alias("_s"))
    zero = F.lit(0.0)
    mean = F.coalesce(F.try_divide(F.aggregate("_s", zero, lambda a, x: a + x), F.size("_s")), zero)
    return samples.select(
        *keys,
        nearest_rank(F.col("_s"), 50).alias("p50"),
        nearest_rank(F.col("_s"), 95).alias("p95"),
        nearest_rank(F.col("_s"), 99).alias("p99"),
        F.coalesce(F.array_min("_s"), zero).alias("min"),
        F.coalesce(F.array_max("_s"), zero).alias("max"),
        mean.alias("mean"),
    )


def linear_percentiles(
    df: DataFrame,
    value: str = "latency_ms",
    keys: Sequence[str] = (),
    percents: Sequence[float] = (50, 95, 99),
    limit: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Mean and exact interpolated percentiles; nulls are ignored, a key without values has nulls.

    Equal values are counted first.  A running count over each key's distinct values, cut into
    slices where there are very many, tells which values hold the wanted ranks.
    """
    if not keys:
        alone = linear_percentiles(df.select(F.lit(0).alias("_all"), value), value, ["_all"], percents, limit)
        empty = df.sparkSession.range(1).select(F.lit(0).alias("_all"))  # one row even without input
        return join_on(empty, alone, ["_all"], "left").drop("_all")
    means = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("_total"))
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    running = running_sums(counts, keys, [value], {"_upto": F.col("_n")}, limit)
    ranked = join_on(running, lookup_side(means.select(*keys, "_total")), keys)
    names, ends = [f"p{p:g}" for p in percents], []
    for name, percent in zip(names, percents):
        at = (F.col("_total") - 1) * percent / 100.0
        for end, rank in (("low", F.floor(at)), ("high", F.ceil(at))):
            ends.append(F.min(F.when(F.col("_upto") > rank, F.col(value))).alias(f"_{end}_{name}"))
    joined = join_on(means, ranked.groupBy(*keys).agg(*ends), keys, "left")
    parts = []
    for name, percent in zip(names, percents):
        at = (F.col("_total") - 1) * percent / 100.0
        low, high = F.col(f"_low_{name}"), F.col(f"_high_{name}")
        parts.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return joined.select(*keys, "mean", *parts)


def nearest_ranks(
    counts: DataFrame, value: str, keys: Sequence[str], n: str = "n", percents: Sequence[float] = (50, 95, 99),
    limit: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Exact nearest-rank percentiles of values that were counted already, one row per (keys, value)."""
    totals = counts.groupBy(*keys).agg(F.sum(n).alias("_total"))
    running = running_sums(counts, keys, [value], {"_upto": F.col(n)}, limit)
    ranked = join_on(running, lookup_side(totals), keys)
    at = lambda p: F.least(F.floor(F.col("_total") * p / 100.0), F.col("_total") - 1)
    return ranked.groupBy(*keys).agg(*[F.min(F.when(F.col("_upto") > at(p), F.col(value))).alias(f"p{p:g}") for p in percents])


def probe_latency(df: DataFrame, value: str = "latency_ms", order: str = "event_id", rows: int = LATENCY_PROBE_ROWS) -> DataFrame:
    """Mean, median, min, max and population deviation of the first ``rows`` samples."""
    first = df.orderBy(order).limit(rows)
    return first.agg(
        F.avg(value).alias("mean_ms"),
        F.percentile(value, F.lit(0.5)).alias("median_ms"),
        F.min(value).alias("min_ms"),
        F.max(value).alias("max_ms"),
        F.stddev_pop(value).alias("std_ms"),
    )


def error_rate_expr(errors: Column, requests: Column) -> Column:
    return F.coalesce(F.try_divide(errors.cast("double"), requests), F.lit(0.0))


def error_rate(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Errors per request (may exceed 1), and errors as a part of everything recorded."""
    alone = F.count_if(F.col("kind") == "error")
    return _grouped(events, keys).agg(
        F.count_if(is_request()).alias("request_count"),
        F.count_if(is_error()).alias("error_count"),
        error_rate_expr(F.count_if(is_error()), F.count_if(is_request())).alias("error_rate"),
        error_rate_expr(F.count_if(is_error()), F.count_if(is_request()) + alone).alias("error_fraction"),
    )


def log_clock(events: DataFrame) -> Column:
    """'Now' of a replayed log: its last event, in microseconds."""
    return events.agg(F.max(micros(F.col("ts")))).scalar()


def throughput(
    events: DataFrame, keys: Sequence[str] = (), now: Column | None = None, policy: MonitorPolicy = POLICY
) -> DataFrame:
    """Requests per second over the trailing window that ends now (microseconds)."""
    clock = log_clock(events) if now is None else now
    timed = events.select(*keys, micros(F.col("ts")).alias("_at"), is_request().alias("_request")).withColumn("_now", clock)
    inside = F.col("_request") & (F.col("_at") >= F.col("_now") - policy.window_sec * 1_000_000)
    n = F.count_if(inside)
    span = (F.max("_now") - F.min(F.when(inside, F.col("_at")))) / 1e6
    rate = F.when((n > 0) & (span > 0), n / span).otherwise(F.lit(0.0))
    return _grouped(timed, keys).agg(rate.alias("throughput_req_sec"))


def recent_predictions(events: DataFrame, keys: Sequence[str] = (), policy: MonitorPolicy = POLICY) -> DataFrame:
    chosen = events.where(is_prediction()).select(*keys, *RECENT, "label")
    return last_n(chosen, keys, RECENT, policy.drift_samples)


def label_shares(events: DataFrame, keys: Sequence[str] = (), policy: MonitorPolicy = POLICY) -> DataFrame:
    """Share of each label among the last N predictions."""
    recent = recent_predictions(events, keys, policy)
    counts = recent.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    totals = _grouped(counts, keys).agg(F.sum("n").alias("total"))
    joined = join_on(counts, totals, keys) if keys else counts.withColumn("total", totals.scalar())
    return joined.select(*keys, "label", "n", (F.col("n") / F.col("total")).alias("share"))


def kl_terms(shares: dict[str, Column], baseline: dict[str, float], policy: MonitorPolicy = POLICY) -> Column:
    """Sum over the baseline of p * ln(p / max(q, floor))."""
    floor = F.lit(policy.drift_floor)
    total = F.lit(0.0)
    for label, p in baseline.items():
        if p > 0:
            total = total + F.lit(p) * F.log(F.lit(p) / F.greatest(shares[label], floor))
    return total


def kl_drift(
    events: DataFrame, baseline: dict[str, float], keys: Sequence[str] = (), policy: MonitorPolicy = POLICY
) -> DataFrame:
    """Divergence of the recent label shares from the baseline; labels outside it are ignored."""
    recent = recent_predictions(events, keys, policy)
    counts = _grouped(recent, keys).agg(
        F.count(F.lit(1)).alias("n_predictions"),
        *[F.count_if(F.col("label") == label).alias(f"_n_{i}") for i, label in enumerate(baseline)],
    )
    shares = {label: F.col(f"_n_{i}") / F.col("n_predictions") for i, label in enumerate(baseline)}
    enough = (F.col("n_predictions") >= policy.drift_min_samples) & F.lit(bool(baseline))
    kl = F.when(enough, kl_terms(shares, baseline, policy)).otherwise(F.lit(0.0))
    return counts.select(
        *keys, "n_predictions", kl.alias("kl"), (kl > policy.drift_threshold).alias("drift_detected")
    )


def baseline_table(events: DataFrame) -> DataFrame:
    """A baseline distribution (label, p) learnt from a log."""
    counts = events.where(is_prediction()).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("label", (F.col("n") / total).alias("p"))


def baseline_dict(table: DataFrame, max_labels: int = 10_000) -> dict[str, float]:
    """The baseline as a driver-side map: one entry per class of the model."""
    rows = table.select("label", "p").limit(max_labels + 1).collect()
    if len(rows) > max_labels:
        raise ValueError("a baseline has one row per class")
    return {r.label: r.p for r in sorted(rows)}


def kl_from_tables(baseline: DataFrame, shares: DataFrame, policy: MonitorPolicy = POLICY) -> DataFrame:
    """The same divergence with the baseline as a table; a missing label counts as the floor."""
    floor = F.lit(policy.drift_floor)
    joined = baseline.join(shares.select("label", "share"), "label", "left")
    term = F.col("p") * F.log(F.col("p") / F.greatest(F.coalesce("share", floor), floor))
    return joined.agg(F.coalesce(F.sum(F.when(F.col("p") > 0, term)), F.lit(0.0)).alias("kl"))


def mean_shift(
    df: DataFrame, baseline_mean: float, value: str = "latency_ms", keys: Sequence[str] = (), threshold: float = 0.3
) -> DataFrame:
    """Whether the mean moved by more than a share of the baseline; no values means no drift."""
    shift = F.abs(F.avg(value) - F.lit(baseline_mean)) / F.lit(max(baseline_mean, 0.001))
    return _grouped(df, keys).agg(
        F.avg(value).alias("mean_value"), F.coalesce(shift > threshold, F.lit(False)).alias("drifted")
    )


def linear_health(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """1 minus a tenth per error, not below 0."""
    return _grouped(events, keys).agg(
        F.greatest(F.lit(0.0), F.lit(1.0) - F.count_if(is_error()) * F.lit(0.1)).alias("health")
    )


def health_score(error_rate: Column, p99: Column, throughput: Column) -> Column:
    """Composite score 0..100: errors, slow tail and idleness each cost points."""
    errors = F.least(F.lit(50.0), error_rate * 500)
    tail = F.least(F.lit(25.0), F.greatest(F.lit(0.0), (p99 - 100) / 16))
    idle = F.when(throughput < 1.0, (F.lit(1.0) - throughput) * 25.0).otherwise(F.lit(0.0))
    return clamp(F.lit(100.0) - errors - tail - idle, 0.0, 100.0)


def health_snapshot(
    events: DataFrame,
    baseline: dict[str, float],
    keys: Sequence[str] = (),
    now: Column | None = None,
    policy: MonitorPolicy = POLICY,
) -> DataFrame:
    """All metrics in one row per key.  The parts are joined on the key they are grouped by."""
    counts = error_rate(events, keys).drop("error_fraction")
    flow = throughput(events, keys, now, policy)
    tail = latency_percentiles(events, keys, policy)
    nested = tail.select(*keys, F.struct("p50", "p95", "p99", "min", "max", "mean").alias("latency"))
    drift = kl_drift(events, baseline, keys, policy).drop("n_predictions")
    if keys:
        joined = join_on(join_on(join_on(counts, flow, keys), nested, keys, "left"), drift, keys, "left")
    else:
        joined = counts.select(
            "*",
            flow.scalar().alias("throughput_req_sec"),
            nested.scalar().alias("latency"),
            drift.select(F.struct("kl", "drift_detected")).scalar().alias("_d"),
        ).select("*", "_d.kl", "_d.drift_detected").drop("_d")
    p99 = F.coalesce(F.col("latency.p99"), F.lit(0.0))
    return joined.select(
        *keys,
        health_score(F.col("error_rate"), p99, F.col("throughput_req_sec")).alias("health_score"),
        "request_count",
        "error_count",
        "error_rate",
        "throughput_req_sec",
        "latency",
        F.coalesce("drift_detected", F.lit(False)).alias("drift_detected"),
        F.coalesce("kl", F.lit(0.0)).alias("kl"),
    )


def with_resources(snapshot: DataFrame, memory_percent: Column, gpu_memory_percent: Column | None = None) -> DataFrame:
    """Add resource usage, clamped to 0..100."""
    gpu = F.lit(0.0) if gpu_memory_percent is None else gpu_memory_percent
    return snapshot.withColumn("memory_percent", clamp(memory_percent, 0.0, 100.0)).withColumn(
        "gpu_memory_percent", clamp(gpu, 0.0, 100.0)
    )


def health_status(
    snapshot: DataFrame,
    model_loaded: Column | bool = True,
    policy: MonitorPolicy = POLICY,
    breakers: DataFrame | None = None,
    keys: Sequence[str] = ("key",),
) -> DataFrame:
    """The snapshot with its verdict, and with each key's ``circuit_state`` if ``breakers`` tell it."""
    loaded = model_loaded if isinstance(model_loaded, Column) else F.lit(model_loaded)
    good = loaded & (F.col("health_score") > policy.healthy_score)
    judged = snapshot.withColumn("status", F.when(good, "healthy").otherwise("degraded"))
    if breakers is None:
        return judged
    joined = join_on(judged, breakers.select(*keys, "circuit_state"), keys, "left")
    return joined.withColumn("circuit_state", F.coalesce("circuit_state", F.lit("closed")))


def metrics_record(snapshot: DataFrame, clock: Column | None = None) -> Column:
    """The nested, rounded record that dashboards read."""
    have = set(snapshot.columns)
    usage = [F.round(F.col(c) if c in have else F.lit(0.0), 2).alias(c) for c in ("memory_percent", "gpu_memory_percent")]
    latency = [F.round(F.col(f"latency.{m}"), 2).alias(m) for m in ("p50", "p95", "p99", "min", "max", "mean")]
    fields = [
        F.round("health_score", 2).alias("health_score"),
        F.col("request_count"),
        F.col("error_count"),
        F.round("error_rate", 4).alias("error_rate"),
        F.round("throughput_req_sec", 2).alias("throughput_req_sec"),
        F.struct(*latency).alias("latency_ms"),
        F.struct(F.col("drift_detected").alias("detected"), F.round("kl", 4).alias("kl_divergence")).alias("drift"),
        F.struct(*usage).alias("resources"),
    ]
    return F.struct(*fields, *([clock.alias("timestamp")] if clock is not None else []))


def metrics_json(snapshot: DataFrame, keys: Sequence[str] = (), clock: Column | None = None) -> DataFrame:
    return snapshot.select(*keys, F.to_json(metrics_record(snapshot, clock)).alias("metrics"))


def since(events: DataFrame, start: Column) -> DataFrame:
    """A reset: counters and samples start again at ``start`` (a baseline is kept apart)."""
    return events.where(F.col("ts") >= start)

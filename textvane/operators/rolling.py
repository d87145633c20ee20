"""Per-event metrics over sliding windows of each key's log.

Sample windows are differences of running sums, so their cost does not grow with the window.
A hot key is cut into slices (see ``scale.sliced``): each slice starts with the rows its
windows look back to, which are dropped afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from textvane.config import ROWS_PER_SLICE, MonitorPolicy, RecoveryPolicy
from textvane.functions.records import micros
from textvane.operators.monitor import error_rate_expr, kl_terms
from textvane.scale import carry_sums, join_on, keys_as_text, keys_as_were, last_n, running_sums, slice_window, sliced, split_hot, with_rank
from textvane.sources.events import is_error, is_prediction, is_request

POLICY = MonitorPolicy()
RECOVERY = RecoveryPolicy()
ORDER = ("ts", "event_id")
KEYS = ("key",)
ROWS_AT_ONCE = 100_000  # whose windows are answered together; performance only


def _with_last_n(df: DataFrame, values: dict[str, Column], n: int, window: Window) -> DataFrame:
    """Sums over the last ``n`` rows as differences of running sums: constant work per row."""
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    running = df.select("*", *[F.sum(value).over(upto).alias(f"_run_{name}") for name, value in values.items()])
    gone = running.select("*", *[F.lag(f"_run_{name}", n).over(window).alias(f"_gone_{name}") for name in values])
    return gone.select(
        *df.columns, *[(F.col(f"_run_{name}") - F.coalesce(f"_gone_{name}", F.lit(0))).alias(name) for name in values]
    )


class WaveletMatrix:
    """Order statistics of any stretch of an array, answered for many stretches at once.

    Level by level, from the highest bit of a value's rank, the array is parted into those with a 0 and
    those with a 1; running counts of the zeros say where a stretch goes (Claude, Navarro, Ordonez,
    Information Systems 47, 2015).
    """

    def __init__(self, values: np.ndarray):
        self.values, now = np.unique(values, return_inverse=True)
        self.bits = max(1, int(self.values.size - 1).bit_length())
        self.zeros = []
        for bit in reversed(range(self.bits)):
            zero = (now >> bit & 1) == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(zero)]))
            now = np.concatenate([now[zero], now[~zero]])

    def kth(self, start: np.ndarray, stop: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The ``k``-th smallest (from 0) of each stretch [start, stop)."""
        rank = np.zeros(k.size, np.int64)
        for upto in self.zeros:
            a, b = upto[start], upto[stop]
            low = k < b - a
            rank = rank * 2 + ~low
            k = np.where(low, k, k - (b - a))
            total = upto[-1]
            start, stop = np.where(low, a, total + start - a), np.where(low, b, total + stop - b)
        return self.values[rank]


LIMB_BITS = 32


def window_means(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Means of stretches from exact sums: a value is four numbers of 32 bits, whole steps of 2**-64.

    Values of 2**62 and more are added up stretch by stretch.
    """
    n = stop - start
    if not values.size or np.abs(values).max() >= 2.0**62:
        return np.array([math.fsum(values[a:b]) / (b - a) for a, b in zip(start.tolist(), stop.tolist())])
    rest, total = values.copy(), np.zeros(start.size)
    sums = []
    for step in (1, 0, -1, -2):
        limb = np.trunc(rest * 2.0 ** (-LIMB_BITS * step))
        rest = rest - limb * 2.0 ** (LIMB_BITS * step)
        upto = np.concatenate([[0], np.cumsum(limb.astype(np.int64))])
        sums.append((step, upto[stop] - upto[start]))
    for step, found in reversed(sums):  # small parts first
        total = total + found * 2.0 ** (LIMB_BITS * step)
    return total / n


def rolling_percentiles(
    events: DataFrame,
    keys: Sequence[str] = KEYS,
    policy: MonitorPolicy = POLICY,
    limit: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Nearest-rank p50/p95/p99, min, max, mean of the last N latencies after each request.

    Requests without a latency have no row and no place in a window.  Means come from exact sums, so
    they do not depend on where a slice starts.

    A sliding sort has no built-in form (a framed collect would re-sort N values per row), so stretches of
    ``ROWS_AT_ONCE`` rows are put into a wavelet matrix that answers all their windows together.
    """
    n = policy.latency_samples
    timed = is_request() & F.col("latency_ms").isNotNull() & ~F.isnan("latency_ms")
    requests = events.where(timed).select(*keys, *ORDER, F.col("latency_ms").cast("double").alias("latency_ms"))
    cut = keys_as_text(sliced(requests, keys, ORDER, n - 1, limit), keys)
    placed = cut.repartition(*keys, "_slice").sortWithinPartitions(*keys, "_slice", *ORDER)
    fields = [f for f in keys_as_text(requests, keys).schema.fields if f.name != "latency_ms"]
    names = ("p50", "p95", "p99", "min", "max", "mean")
    out = T.StructType([*fields, *[T.StructField(m, T.DoubleType()) for m in names]])
    groups = [*keys, "_slice"]

    def measured(rows: pd.DataFrame) -> pd.DataFrame:
        """``rows`` holds slices one after another, each from its start or with the rows its windows look back to."""
        changed = np.zeros(len(rows), bool)
        for name in groups:
            column = rows[name]
            before = column.shift()
            changed |= ~((column == before) | (column.isna() & before.isna())).to_numpy()
        changed[:1] = True
        stop = np.arange(1, len(rows) + 1)
        first = np.maximum.accumulate(np.where(changed, stop - 1, 0))
        start = np.maximum(first, stop - n)
        values = rows["latency_ms"].to_numpy()
        matrix, m = WaveletMatrix(values), stop - start
        result = rows[[*keys, *ORDER]].copy()
        for name, p in (("p50", 50), ("p95", 95), ("p99", 99)):
            result[name] = matrix.kth(start, stop, np.minimum((m * p / 100.0).astype(np.int64), m - 1))
        result["min"], result["max"] = matrix.kth(start, stop, np.zeros_like(m)), matrix.kth(start, stop, m - 1)
        result["mean"] = window_means(values, start, stop)
        return result[~rows["_warmup"].to_numpy(bool)]

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of the slice that goes on in later frames only the rows its next windows look back to are held."""
        held, size = [], 0
        for frame in frames:
            held.append(frame)
            size += len(frame)
            if size < ROWS_AT_ONCE:
                continue
            rows = pd.concat(held, ignore_index=True)
            yield measured(rows)
            last = rows[groups].iloc[-1]
            rows = rows.tail(n - 1)
            open_ = np.ones(len(rows), bool)
            for name in groups:
                open_ &= (rows[name].isna() if pd.isna(last[name]) else rows[name] == last[name]).to_numpy()
            held, size = [rows[open_].assign(_warmup=True)], 0
        if size:
            yield measured(pd.concat(held, ignore_index=True))

    walked = placed.select(*keys, *ORDER, "latency_ms", "_slice", "_warmup").mapInPandas(walk, out)
    return keys_as_were(walked, keys, requests)


def rolling_drift(
    events: DataFrame,
    baseline: dict[str, float],
    keys: Sequence[str] = KEYS,
    policy: MonitorPolicy = POLICY,
    limit: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Divergence of the last N predictions after each prediction, once there are enough."""
    n = policy.drift_samples
    chosen = events.where(is_prediction()).select(*keys, *ORDER, "label")
    cut = sliced(chosen, keys, ORDER, n - 1, limit)
    window = slice_window(keys, ORDER)
    counts = {f"_n_{i}": F.when(F.col("label") == label, 1).otherwise(0) for i, label in enumerate(baseline)}
    out = _with_last_n(cut, {"n_predictions": F.lit(1), **counts}, n, window)
    shares = {label: F.col(f"_n_{i}") / F.col("n_predictions") for i, label in enumerate(baseline)}
    enough = (F.col("n_predictions") >= policy.drift_min_samples) & F.lit(bool(baseline))
    kl = F.when(enough, kl_terms(shares, baseline, policy)).otherwise(F.lit(0.0))
    return out.where(~F.col("_warmup")).select(
        *keys, *ORDER, "n_predictions", kl.alias("kl"), (kl > policy.drift_threshold).alias("drift_detected")
    )


def rolling_throughput(
    events: DataFrame,
    keys: Sequence[str] = KEYS,
    policy: MonitorPolicy = POLICY,
    limit: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Requests per second over the trailing window at each request.

    Every request sends out a probe at (its time - window).  In one time order of requests
    and probes, the running count at the probe tells how many requests fell out of the window,
    and the next request after it is the oldest one inside: no frame is ever re-scanned.
    """
    requests = events.where(is_request()).select(*keys, "event_id", "ts", micros(F.col("ts")).alias("_at"))
    ranked = _ranked(requests, keys, ("_at", "event_id"), limit)
    moments = F.array(
        F.struct(F.col("_at").alias("_when"), F.lit(1).alias("_is_event")),
        F.struct((F.col("_at") - policy.window_sec * 1_000_000).alias("_when"), F.lit(0).alias("_is_event")),
    )
    timeline = ranked.select("*", F.explode(moments).alias("_m")).select(*ranked.columns, "_m._when", "_m._is_event")
    order = ("_when", "_is_event", "event_id")
    cut = sliced(timeline, keys, order, 0, limit)
    counted = carry_sums(cut, [*timeline.columns, "_slice"], keys, order, {"_gone": F.col("_is_event").cast("long")})
    backwards = Window.partitionBy(*keys, "_slice").orderBy(*[F.col(c).desc() for c in order])
    event_time = F.when(F.col("_is_event") == 1, F.col("_when"))
    local = counted.withColumn(
        "_next", F.min(event_time).over(backwards.rowsBetween(Window.unboundedPreceding, 0))
    )
    # the oldest request may lie in a later slice: the first request of each later slice is known
    firsts = cut.where("_slice > 0").groupBy(*keys, "_slice").agg(F.min(event_time).alias("_first"))
    if firsts.isEmpty():
        located = local.withColumn("_oldest", F.col("_next"))
    else:
        later = Window.partitionBy(*keys).orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, 0)
        carried = firsts.select(*keys, (F.col("_slice") - 1).alias("_slice"), F.min("_first").over(later).alias("_ahead"))
        joined = join_on(local, carried, [*keys, "_slice"], "left")
        located = joined.withColumn("_oldest", F.coalesce("_next", "_ahead"))
    n = F.col("_rank") + 1 - F.col("_gone")
    span = (F.col("_at") - F.col("_oldest")) / 1e6
    return located.where("_is_event = 0").select(
        *keys,
        "ts",
        "event_id",
        n.alias("n_in_window"),
        F.when(span > 0, n / span).otherwise(F.lit(0.0)).alias("throughput_req_sec"),
    )


def _ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int) -> DataFrame:
    """Zero-based rank per key; hot keys are ranked without gathering them."""
    cold, hot = split_hot(df, keys, limit)
    window = Window.partitionBy(*keys).orderBy(*order)
    simple = cold.withColumn("_rank", (F.row_number().over(window) - 1).cast("long"))
    return simple if hot is None else simple.unionByName(with_rank(hot, keys, order))


def running_error_rate(
    events: DataFrame, keys: Sequence[str] = KEYS, limit: int = ROWS_PER_SLICE
) -> DataFrame:
    """Counters and error rate since the start of the log, after each event."""
    return _running_rate(events, keys, limit).drop("_r")


def _running_rate(events: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """The same with ``_r``: whether the row is a request."""
    slim = events.select(*keys, *ORDER, is_request().alias("_r"), is_error().alias("_e"))
    sums = {"request_count": F.col("_r").cast("long"), "error_count": F.col("_e").cast("long")}
    counted = running_sums(slim, keys, ORDER, sums, limit)
    rate = error_rate_expr(F.col("error_count"), F.col("request_count"))
    return counted.select(*keys, *ORDER, "request_count", "error_count", rate.alias("error_rate"), "_r")


def quality_degradation(
    events: DataFrame,
    keys: Sequence[str] = KEYS,
    policy: RecoveryPolicy = RECOVERY,
    limit: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Alert rows: the mean confidence of the last few predictions fell too far below the baseline."""
    n = policy.quality_samples
    slim = events.where(is_prediction()).select(*keys, *ORDER, "confidence")
    cut = sliced(slim, keys, ORDER, n - 1, limit)
    frame = slice_window(keys, ORDER).rowsBetween(-(n - 1), 0)
    measured = cut.select(
        "*", F.avg("confidence").over(frame).alias("recent_confidence"), F.count("confidence").over(frame).alias("_n")
    )
    base = F.lit(policy.quality_baseline)
    drop = (base - F.col("recent_confidence")) / base
    return (
        measured.where(~F.col("_warmup") & (F.col("_n") == n))
        .withColumn("degradation", drop)
        .where(F.col("degradation") > policy.quality_threshold)
        .select(*keys, *ORDER, "recent_confidence", "degradation")
    )


def error_spikes(
    events: DataFrame,
    keys: Sequence[str] = KEYS,
    policy: RecoveryPolicy = RECOVERY,
    limit: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Alert rows: too many errors among the last N events (a full window is required)."""
    n = policy.error_rate_samples
    slim = events.select(*keys, *ORDER, is_error().cast("long").alias("_e"))
    cut = sliced(slim, keys, ORDER, n - 1, limit)
    window = slice_window(keys, ORDER)
    counted = _with_last_n(cut, {"_n": F.lit(1), "_errors": F.col("_e")}, n, window)
    rate = F.col("_errors") / F.lit(n)
    full = ~F.col("_warmup") & (F.col("_n") == n)
    return counted.where(full & (rate > policy.error_rate_threshold)).select(
        *keys, *ORDER, rate.alias("window_error_rate")
    )


def keep_last(df: DataFrame, n: int, keys: Sequence[str] = (), order: Sequence[str] = ORDER) -> DataFrame:
    """Sliding retention: the newest ``n`` rows of each key."""
    return last_n(df, keys, order, n)


def alerts(
    events: DataFrame,
    baseline: dict[str, float] | None = None,
    keys: Sequence[str] = KEYS,
    policy: MonitorPolicy = POLICY,
    limit: int = ROWS_PER_SLICE,
) -> DataFrame:
    """(key, ts, event_id, alert_type, value): slow requests, high error rate, drift."""
    columns = [*keys, *ORDER]
    slow = events.where(is_request() & (F.col("latency_ms") > policy.latency_alert_ms)).select(
        *columns, F.lit("latency_spike").alias("alert_type"), F.col("latency_ms").alias("value")
    )
    # checked when a request ends, as the requests are what is being watched
    running = _running_rate(events, keys, limit).where(F.col("_r") & (F.col("error_rate") > policy.error_rate_alert))
    failing = running.select(*columns, F.lit("error_spike").alias("alert_type"), F.col("error_rate").alias("value"))
    rows = slow.unionByName(failing)
    if baseline:
        drifting = rolling_drift(events, baseline, keys, policy, limit).where("drift_detected").select(
            *columns, F.lit("drift").alias("alert_type"), F.col("kl").alias("value")
        )
        rows = rows.unionByName(drifting)
    return rows

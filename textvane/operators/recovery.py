"""Fault detectors over an event log: circuit breaker, latency spikes, cool-downs, audit log."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from textvane.config import ROWS_PER_SLICE, RecoveryPolicy
from textvane.operators.replay import Machine, build_machine, replay
from textvane.operators.rolling import quality_degradation
from textvane.scale import last_n
from textvane.sources.events import is_error, is_request, is_reset

POLICY = RecoveryPolicy()
KEYS = ("key",)


def breaker_machine(policy: RecoveryPolicy = POLICY, variant: str = "standard", strict: bool = False) -> Machine:
    """Circuit breaker as a state table.

    States are (phase, failures, probe successes); failures are counted up to the threshold,
    beyond which they make no difference.  In the standard rule a success clears the
    failures, so after one good probe a single failure leaves the circuit half open; with
    ``strict`` any failed probe re-opens it.  In the ``sticky`` variant failures are cleared
    only while closed, and a fixed number of good probes closes the circuit.
    """
    if variant not in ("standard", "sticky"):
        raise ValueError(f"unknown breaker variant: {variant}")
    top, needed = policy.failure_threshold, policy.half_open_successes

    def step(state: tuple, failed: int) -> tuple | None:
        phase, failures, good = state
        if failed:
            failures = min(top, failures + 1)
            reopen = failures >= top or (strict and phase == "half_open")
            return None if reopen else (phase, failures, good)
        if phase == "closed":
            return ("closed", 0, 0)
        good += 1
        if good >= needed:
            return ("closed", 0, 0)
        return ("half_open", failures if variant == "sticky" else 0, good)

    return build_machine(
        ("closed", 0, 0), step, ("half_open", top, 0), policy.recovery_timeout_sec, lambda s: s[0], "open"
    )


def forgetting(machine: Machine, idle_sec: float | None) -> Machine:
    """The machine, back at its start when its key returns after more than ``idle_sec``."""
    return machine if idle_sec is None else replace(machine, idle_us=round(idle_sec * 1e6))


# fixed values: what the optional transition log says
TRANSITIONS = {
    ("closed", "open"): "Circuit opened due to failure threshold",
    ("half_open", "open"): "Circuit opened due to failure threshold",
    ("open", "half_open"): "Circuit transitioned to HALF_OPEN",
    ("half_open", "closed"): "Circuit closed after successful recovery",
}


def circuit_breaker(
    events: DataFrame,
    policy: RecoveryPolicy = POLICY,
    keys: Sequence[str] = KEYS,
    variant: str = "standard",
    strict: bool = False,
    log: bool = False,
    since: Column | None = None,
    idle_sec: float | None = None,
    limit: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Gate every event by the breaker of its key: state before, allowed or not, state after.

    Events of the kind ``reset`` close their key's breaker at once.
    """
    replayed = events if since is None else events.where(F.col("ts") >= since)
    machine = forgetting(breaker_machine(policy, variant, strict), idle_sec)
    replayed = replay(replayed, machine, is_error(), keys, limit, is_reset())
    out = gated(replayed, keys)
    if not log:
        return out
    out = replayed.select(*out.columns[:-2], F.col("accepted").alias("allowed"), "state_after", "reset")
    woke = (F.col("state_before") == "open") & F.col("allowed") & ~F.col("reset")
    entered = F.when(woke, F.lit("half_open")).otherwise(F.col("state_before"))
    message = F.lit(None).cast("string")
    for (before, after), text in TRANSITIONS.items():
        if before != "open":
            message = F.when((entered == before) & (F.col("state_after") == after), F.lit(text)).otherwise(message)
    probe = F.when(woke, F.lit(TRANSITIONS[("open", "half_open")]))
    said = F.when(F.col("reset"), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(probe, message)))
    return out.withColumn("log", said).drop("reset")


def gated(replayed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Breaker rows of a replayed log."""
    return replayed.select(*keys, "ts", "event_id", "state_before", F.col("accepted").alias("allowed"), "state_after")


def circuit_states(replayed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The state each breaker was left in."""
    return replayed.groupBy(*keys).agg(
        F.max_by("state_after", F.struct("ts", "event_id")).alias("circuit_state"),
        F.count_if(~F.col("allowed")).alias("n_rejected"),
    )


def resets(samples: DataFrame) -> Column | None:
    """Events of the kind ``reset``, in a log that tells kinds apart."""
    return is_reset() if "kind" in samples.columns else None


def spike_machine(samples: int) -> Machine:
    """Clamped counter: up on a spike, down otherwise, back to 0 when it fires."""

    def step(state: tuple, spike: int) -> tuple:
        (count,) = state
        return ((count + 1) % samples,) if spike else (max(0, count - 1),)

    return build_machine((0,), step, label=lambda s: str(s[0]))


def latency_spikes(
    samples: DataFrame,
    p99: Column,
    baseline_p95: Column,
    policy: RecoveryPolicy = POLICY,
    keys: Sequence[str] = KEYS,
    limit: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Spike counter after each sample, and ``fired`` when spikes persisted."""
    spike = p99 > baseline_p95 * policy.spike_multiplier
    machine = spike_machine(policy.spike_samples)
    return counted_spikes(replay(samples, machine, spike, keys, limit, resets(samples)), policy, keys)


def counted_spikes(replayed: DataFrame, policy: RecoveryPolicy = POLICY, keys: Sequence[str] = KEYS) -> DataFrame:
    """Spike rows of a replayed log."""
    machine = spike_machine(policy.spike_samples)
    last = F.col("code_before") == machine.names.index(str(policy.spike_samples - 1))
    count = F.col("state_after").cast("int").alias("spike_count")
    return replayed.select(*keys, "ts", "event_id", count, (last & F.col("flag")).alias("fired"))


def cooldown_machine(cooldown_sec: float) -> Machine:
    """Accept an event, then refuse others until the cool-down has passed."""
    return build_machine(("ready",), lambda state, flag: None if flag else state, ("ready",), cooldown_sec, lambda s: s[0], "cooling")


def batch_sizes_after(policy: RecoveryPolicy = POLICY) -> list[int]:
    """Batch size after 0, 1, 2, ... accepted reductions, up to where it stays."""
    sizes = [policy.batch_start]
    while True:
        smaller = max(policy.batch_floor, int(sizes[-1] * policy.batch_factor))
        if smaller == sizes[-1]:
            return sizes
        sizes.append(smaller)


def batch_reduction(
    overflows: DataFrame, policy: RecoveryPolicy = POLICY, keys: Sequence[str] = KEYS, limit: int = ROWS_PER_SLICE
) -> DataFrame:
    """Out-of-memory events that are accepted (outside the cool-down) with old and new batch size.

    A reset among them brings the batch size back to where it began; the cool-down goes on.
    """
    machine = cooldown_machine(policy.batch_cooldown_sec)
    return reduced(replay(overflows, machine, is_overflow(overflows), keys, limit), policy, keys)


def is_overflow(overflows: DataFrame) -> Column:
    """Every event but a reset."""
    reset = resets(overflows)
    return F.lit(True) if reset is None else ~reset


def reduced(replayed: DataFrame, policy: RecoveryPolicy = POLICY, keys: Sequence[str] = KEYS) -> DataFrame:
    """Batch sizes of a replayed log.

    Accepted events of a key are at least a cool-down apart, and resets are an operator's: they are few.
    """
    ordered = Window.partitionBy(*keys).orderBy("ts", "event_id")
    events = replayed.where("accepted or not flag").withColumn("_resets", F.count_if(~F.col("flag")).over(ordered))
    nth = F.row_number().over(Window.partitionBy(*keys, "_resets").orderBy("ts", "event_id"))
    sizes = batch_sizes_after(policy)
    ladder = F.array(*[F.lit(s) for s in sizes])
    at = F.least(F.col("_nth"), F.lit(len(sizes) - 1))
    return (
        events.where("flag")
        .withColumn("_nth", nth)
        .select(
            *keys,
            "ts",
            "event_id",
            F.get(ladder, F.least(F.col("_nth") - 1, F.lit(len(sizes) - 1))).alias("old_batch_size"),
            F.get(ladder, at).alias("new_batch_size"),
        )
    )


# fixed values: kinds of actions and why they are taken
REASONS = {
    "model_reload_quality": "Prediction quality degradation detected",
    "quantized_model_switch": "Persistent latency spikes detected",
    "batch_size_reduction": "Out-of-memory detected",
}


def _action(rows: DataFrame, kind: str, details: dict[str, Column]) -> DataFrame:
    pairs = [x for name, value in details.items() for x in (F.lit(name), value.cast("string"))]
    return rows.select(
        F.col("key").cast("string").alias("key"),
        "ts",
        "event_id",
        F.lit(kind).alias("action_type"),
        F.lit(REASONS[kind]).alias("reason"),
        F.lit(True).alias("success"),
        F.create_map(*pairs).alias("details"),
    )


def recovery_actions(
    quality: DataFrame | None = None,
    spikes: DataFrame | None = None,
    reductions: DataFrame | None = None,
    policy: RecoveryPolicy = POLICY,
) -> DataFrame:
    """The audit rows of the detectors' alerts."""
    parts = []
    if quality is not None:
        parts.append(
            _action(
                quality,
                "model_reload_quality",
                {
                    "baseline_confidence": F.lit(policy.quality_baseline),
                    "recent_confidence": F.round("recent_confidence", 3),
                    "degradation_percent": F.round(F.col("degradation") * 100, 2),
                },
            )
        )
    if spikes is not None:
        parts.append(
            _action(
                spikes.where("fired"),
                "quantized_model_switch",
                {"spike_count": F.lit(policy.spike_samples)},
            )
        )
    if reductions is not None:
        parts.append(
            _action(
                reductions,
                "batch_size_reduction",
                {
                    "old_batch_size": F.col("old_batch_size"),
                    "new_batch_size": F.col("new_batch_size"),
                    "reduction_factor": F.lit(policy.batch_factor),
                },
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def detect_all(events: DataFrame, baseline_p95: float, policy: RecoveryPolicy = POLICY) -> DataFrame:
    """Quality, spike and cool-down actions of one log; failed requests stand for overflows."""
    requests = events.where(is_request())
    return recovery_actions(
        quality_degradation(events, KEYS, policy),
        latency_spikes(requests, F.col("latency_ms"), F.lit(baseline_p95), policy),
        batch_reduction(events.where(is_error()), policy),
        policy,
    )


def recovery_history(actions: DataFrame, limit: int = 100) -> DataFrame:
    """The last ``limit`` actions in log order."""
    order = ["ts", "event_id", "action_type"]
    return last_n(actions, [], order, limit).orderBy(*order)

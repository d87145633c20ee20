"""Registered queries on the request log: metrics, windows, fault detection, streams."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from textvane.catalog.tables import TENANT, Catalog, as_events, ev, events, plain_ts, r6, steady, table
from textvane.config import DEFAULT_BATCH_SIZE, MonitorPolicy, RecoveryPolicy
from textvane.functions.records import micros
from textvane.operators import monitor, recovery, rolling
from textvane.session import scratch_path, use_utc
from textvane.sources import sinks
from textvane.sources.events import EVENTS, is_prediction, load_events, stream_files
from textvane.streaming import folds, jobs

CATALOG = Catalog()
KEY = ["key"]

# what the registered queries expect of the label mix, and gaps of hours instead of seconds
BASELINE = {"view": 0.5, "click": 0.25, "purchase": 0.15, "signup": 0.1}
PATIENT = RecoveryPolicy(failure_threshold=2, recovery_timeout_sec=6 * 3600.0, batch_cooldown_sec=6 * 3600.0, error_rate_threshold=0.25)
SENSITIVE = RecoveryPolicy(error_rate_threshold=0.05)
SPIKE_BASELINE = 12.0


def baseline_sql() -> str:
    return "bl(label, p) AS (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in BASELINE.items()) + ")"


def tail_sql(source: str, by: str = "key") -> str:
    """Nearest-rank percentiles of the last 1000 latencies per group."""
    part = f"PARTITION BY {by} " if by else ""
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""last AS (SELECT {lead}latency_ms FROM (SELECT *, row_number() OVER ({part}ORDER BY ts DESC, event_id DESC) AS k
  FROM {source}) WHERE k <= 1000), smp AS (SELECT {lead}list_sort(list(latency_ms)) AS s, count(*) AS n FROM last {group}),
tail AS (SELECT {lead}s[least(CAST(floor(n * 50.0::DOUBLE / 100) AS BIGINT) + 1, n)] AS p50,
  s[least(CAST(floor(n * 95.0::DOUBLE / 100) AS BIGINT) + 1, n)] AS p95,
  s[least(CAST(floor(n * 99.0::DOUBLE / 100) AS BIGINT) + 1, n)] AS p99, s[1] AS min, s[n] AS max, list_avg(s) AS mean FROM smp)"""


TAIL = "p50, p95, p99, min, max, round(mean + 1e-9, 6) AS mean"


@CATALOG.add(f"WITH {ev()}, {tail_sql('ev')} SELECT key, {TAIL} FROM tail")
def latency_percentiles(spark, folder):
    return monitor.latency_percentiles(events(spark, folder), KEY).withColumn("mean", steady("mean"))


@CATALOG.add(f"WITH {ev()}, {tail_sql('ev', '')} SELECT {TAIL} FROM tail")
def latency_percentiles_overall(spark, folder):
    return monitor.latency_percentiles(events(spark, folder)).withColumn("mean", steady("mean"))


@CATALOG.add(
    f"""WITH {ev()} SELECT label, round(avg(latency_ms) + 1e-9, 6) AS mean, round(quantile_cont(latency_ms, 0.5), 6) AS p50,
  round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99 FROM ev GROUP BY label"""
)
def latency_linear_stats(spark, folder):
    stats = monitor.linear_percentiles(events(spark, folder), keys=["label"])
    return stats.select("label", steady("mean"), *[r6(c) for c in ("p50", "p95", "p99")])


@CATALOG.add(
    """SELECT l_returnflag, round(avg(l_extendedprice) + 1e-9, 4) AS mean, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50,
  round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99
  FROM lineitem GROUP BY l_returnflag"""
)
def price_linear_stats(spark, folder):
    """The same statistics on the widest table, to watch how they scale."""
    rows = table(spark, folder, "lineitem").select("l_returnflag", "l_extendedprice")
    stats = monitor.linear_percentiles(rows, "l_extendedprice", ["l_returnflag"])
    return stats.select("l_returnflag", steady("mean", 4), *[r6(c) for c in ("p50", "p95", "p99")])


@CATALOG.add(
    f"""WITH {ev()}, f AS (SELECT latency_ms FROM ev ORDER BY event_id LIMIT 100) SELECT round(avg(latency_ms) + 1e-9, 6) AS mean_ms,
  median(latency_ms) AS median_ms, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms,
  round(stddev_pop(latency_ms), 6) AS std_ms FROM f"""
)
def latency_probe(spark, folder):
    probe = monitor.probe_latency(events(spark, folder))
    return probe.select(steady("mean_ms"), "median_ms", "min_ms", "max_ms", r6("std_ms"))


KINDS = "CASE event_id % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'prediction' END"


@CATALOG.add(
    f"""WITH raw AS (SELECT user_id AS key, coalesce({KINDS}, 'request') AS kind, CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE event_type END AS label,
    event_id % 7 = 0 AS failed FROM events)
  SELECT key, count(*) FILTER (kind = 'request') AS request_count,
    count(*) FILTER (kind = 'error' OR (kind = 'request' AND failed)) AS error_count,
    count(*) FILTER (kind = 'prediction' OR (kind = 'request' AND label <> 'unknown')) AS prediction_count FROM raw GROUP BY key"""
)
def mixed_event_kinds(spark, folder):
    """A log of requests, errors and predictions whose records leave fields out, read back from JSON."""
    raw = table(spark, folder, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").cast("string").alias("key"),
        F.expr(KINDS).alias("kind"),
        F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("label"),
        F.when(F.col("event_id") % 7 == 0, True).alias("error"),
    )
    path = scratch_path(spark, "mixed-log")
    raw.write.json(path)  # nulls are left out
    log = load_events(spark, path, "json", EVENTS)
    rates = monitor.error_rate(log, KEY).select(F.col("key").cast("long").alias("key"), "request_count", "error_count")
    said = log.groupBy(F.col("key").cast("long").alias("key")).agg(F.count_if(is_prediction()).alias("prediction_count"))
    return rates.join(said, "key")


RATE_SQL = """count(*) AS request_count, count(*) FILTER (error) AS error_count,
  round(count(*) FILTER (error)::DOUBLE / count(*), 6) AS error_rate"""


@CATALOG.add(f"WITH {ev()} SELECT key, {RATE_SQL}, round(count(*) FILTER (error)::DOUBLE / count(*), 6) AS error_fraction FROM ev GROUP BY key")
def error_rate(spark, folder):
    rates = monitor.error_rate(events(spark, folder), KEY)
    return rates.withColumn("error_rate", F.round("error_rate", 6)).withColumn("error_fraction", F.round("error_fraction", 6))


FLOW = """flow AS (SELECT key, count(*) FILTER (us >= now - 3600000000) AS n,
    (any_value(now) - min(us) FILTER (us >= now - 3600000000)) / 1e6::DOUBLE AS span
    FROM ev, (SELECT max(us) AS now FROM ev) GROUP BY key),
  thr AS (SELECT key, CASE WHEN n > 0 AND span > 0 THEN n / span ELSE 0.0 END AS t FROM flow)"""


@CATALOG.add(f"WITH {ev()}, {FLOW} SELECT key, round(t, 9) AS throughput_req_sec FROM thr")
def throughput(spark, folder):
    return monitor.throughput(events(spark, folder), KEY).withColumn("throughput_req_sec", F.round("throughput_req_sec", 9))


def recent_sql(by: str = "key") -> str:
    part, lead = (f"PARTITION BY {by} ", f"{by}, ") if by else ("", "")
    return f"""recent AS (SELECT {lead}label FROM (SELECT *, row_number() OVER ({part}ORDER BY ts DESC, event_id DESC) AS k
  FROM ev) WHERE k <= 500)"""


@CATALOG.add(
    f"""WITH {ev(TENANT)}, {recent_sql()} SELECT key, label, count(*) AS n,
  round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY key), 6) AS share FROM recent GROUP BY key, label"""
)
def label_shares(spark, folder):
    return monitor.label_shares(events(spark, folder, TENANT), KEY).withColumn("share", F.round("share", 6))


KL_SQL = f"""{baseline_sql()}, tot AS (SELECT key, count(*) AS n FROM recent GROUP BY key),
  q AS (SELECT t.key, t.n, b.p, greatest((SELECT count(*) FROM recent r WHERE r.key = t.key AND r.label = b.label)::DOUBLE / t.n, 1e-6::DOUBLE) AS q
    FROM tot t, bl b),
  kl AS (SELECT key, n, CASE WHEN n >= 100 THEN sum(p * ln(p / q)) ELSE 0.0 END AS kl FROM q GROUP BY key, n)"""


@CATALOG.add(
    f"""WITH {ev(TENANT)}, {recent_sql()}, {KL_SQL} SELECT key, n AS n_predictions, round(kl, 6) AS kl, kl > 0.15 AS drift_detected FROM kl"""
)
def kl_drift(spark, folder):
    return monitor.kl_drift(events(spark, folder, TENANT), BASELINE, KEY).withColumn("kl", F.round("kl", 6))


@CATALOG.add(
    f"""WITH {ev()}, {recent_sql('')}, base AS (SELECT label, count(*)::DOUBLE / (SELECT count(*) FROM ev) AS p FROM ev GROUP BY label),
  e AS (SELECT label, count(*)::DOUBLE / 500 AS q FROM recent GROUP BY label)
  SELECT round(sum(p * ln(p / greatest(coalesce(q, 1e-6), 1e-6))), 6) AS kl FROM base LEFT JOIN e USING (label)"""
)
def kl_drift_learnt_baseline(spark, folder):
    log = events(spark, folder)
    return monitor.kl_from_tables(monitor.baseline_table(log), monitor.label_shares(log)).select(r6("kl"))


@CATALOG.add(
    f"""WITH {ev()} SELECT key, round(avg(latency_ms) + 1e-9, 6) AS mean_value, abs(avg(latency_ms) - 50.0::DOUBLE) / 50.0::DOUBLE > 0.3::DOUBLE AS drifted
  FROM ev GROUP BY key"""
)
def mean_shift_drift(spark, folder):
    return monitor.mean_shift(events(spark, folder), 50.0, keys=KEY).withColumn("mean_value", steady("mean_value"))


@CATALOG.add(f"WITH {ev()} SELECT key, round(greatest(0.0::DOUBLE, 1.0::DOUBLE - count(*) FILTER (error) * 0.1::DOUBLE), 6) AS health FROM ev GROUP BY key")
def linear_health(spark, folder):
    return monitor.linear_health(events(spark, folder), KEY).withColumn("health", F.round("health", 6))


SCORE = """greatest(0.0, least(100.0, 100.0::DOUBLE - least(50.0::DOUBLE, r * 500) - least(25.0::DOUBLE, greatest(0.0::DOUBLE, (p99 - 100) / 16))
  - CASE WHEN t < 1.0 THEN 25.0::DOUBLE * (1.0::DOUBLE - t) ELSE 0.0 END))"""
SNAPSHOT = f"""{FLOW}, {tail_sql('ev')}, {recent_sql()}, {KL_SQL},
  rate AS (SELECT key, count(*) AS request_count, count(*) FILTER (error) AS error_count,
    count(*) FILTER (error)::DOUBLE / count(*) AS r FROM ev GROUP BY key),
  snap AS (SELECT key, {SCORE} AS score, request_count, error_count, r, t, p50, p95, p99, min, max, mean, kl
    FROM rate JOIN thr USING (key) JOIN tail USING (key) JOIN kl USING (key))"""


@CATALOG.add(f"WITH {ev()}, {SNAPSHOT} SELECT key, round(score, 6) AS health_score FROM snap")
def health_score(spark, folder):
    return monitor.health_snapshot(events(spark, folder), BASELINE, KEY).select("key", r6("health_score"))


SNAP_COLUMNS = """round(score, 6) AS health_score, request_count, error_count, round(r, 6) AS error_rate,
  round(t, 9) AS throughput_req_sec, p50, p95, p99, round(mean + 1e-9, 6) AS mean, kl > 0.15 AS drift_detected, round(kl, 6) AS kl"""


def snapshot_columns(snapshot, *lead):
    return snapshot.select(
        *lead,
        r6("health_score"),
        "request_count",
        "error_count",
        r6("error_rate"),
        F.round("throughput_req_sec", 9).alias("throughput_req_sec"),
        *[F.col(f"latency.{c}").alias(c) for c in ("p50", "p95", "p99")],
        steady("latency.mean", alias="mean"),
        "drift_detected",
        r6("kl"),
    )


@CATALOG.add(f"WITH {ev()}, {SNAPSHOT} SELECT key, {SNAP_COLUMNS} FROM snap")
def health_snapshot(spark, folder):
    return snapshot_columns(monitor.health_snapshot(events(spark, folder), BASELINE, KEY), "key")


@CATALOG.add(f"WITH {ev('0')}, {SNAPSHOT} SELECT {SNAP_COLUMNS} FROM snap")
def health_snapshot_overall(spark, folder):
    return snapshot_columns(monitor.health_snapshot(events(spark, folder), BASELINE))


@CATALOG.add(
    f"""WITH {ev()}, {SNAPSHOT} SELECT key, round(score, 2) AS health_score, request_count, round(r, 4) AS error_rate,
  round(p99, 2) AS p99, round(mean, 2) AS mean, kl > 0.15 AS detected, round(kl, 4) AS kl_divergence FROM snap"""
)
def metrics_json(spark, folder):
    """The JSON records, read back by field."""
    records = monitor.metrics_json(monitor.health_snapshot(events(spark, folder), BASELINE, KEY), KEY)
    shape = (
        "health_score double, request_count bigint, error_rate double, latency_ms struct<p99 double, mean double>, "
        "drift struct<detected boolean, kl_divergence double>"
    )
    read = records.select("key", F.from_json("metrics", shape).alias("m"))
    return read.select(
        "key", "m.health_score", "m.request_count", "m.error_rate", "m.latency_ms.p99", "m.latency_ms.mean",
        "m.drift.detected", "m.drift.kl_divergence",
    )


ORDERED = "ORDER BY ts, event_id"


@CATALOG.add(
    f"""WITH {ev(TENANT)}, w AS (SELECT key, event_id, list(latency_ms) OVER (PARTITION BY key {ORDERED} ROWS BETWEEN 999 PRECEDING AND CURRENT ROW) AS l FROM ev),
  s AS (SELECT key, event_id, list_sort(l) AS s, len(l) AS n FROM w)
  SELECT key, event_id, s[least(CAST(floor(n * 50.0::DOUBLE / 100) AS BIGINT) + 1, n)] AS p50,
    s[least(CAST(floor(n * 95.0::DOUBLE / 100) AS BIGINT) + 1, n)] AS p95,
    s[least(CAST(floor(n * 99.0::DOUBLE / 100) AS BIGINT) + 1, n)] AS p99, s[1] AS min, s[n] AS max, round(list_avg(s) + 1e-9, 6) AS mean FROM s"""
)
def rolling_percentiles(spark, folder):
    out = rolling.rolling_percentiles(events(spark, folder, TENANT))
    return out.select("key", "event_id", "p50", "p95", "p99", "min", "max", steady("mean"))


@CATALOG.add(
    f"""WITH {ev()}, w AS (SELECT key, event_id, count(*) OVER x AS request_count, count(*) FILTER (error) OVER x AS error_count
    FROM ev WINDOW x AS (PARTITION BY key {ORDERED} ROWS UNBOUNDED PRECEDING))
  SELECT *, round(error_count::DOUBLE / request_count, 6) AS error_rate FROM w"""
)
def running_error_rate(spark, folder):
    out = rolling.running_error_rate(events(spark, folder))
    return out.drop("ts").withColumn("error_rate", F.round("error_rate", 6))


@CATALOG.add(
    f"""WITH {ev(TENANT)}, w AS (SELECT key, event_id, ts, count(*) OVER x AS n, count(*) FILTER (error) OVER x AS e
    FROM ev WINDOW x AS (PARTITION BY key {ORDERED} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
  SELECT key, event_id, ts, round(e::DOUBLE / 100, 6) AS window_error_rate FROM w WHERE n = 100 AND e::DOUBLE / 100 > 0.25"""
)
def windowed_error_spike(spark, folder):
    spikes = rolling.error_spikes(events(spark, folder, TENANT), policy=PATIENT)
    return plain_ts(spikes).withColumn("window_error_rate", F.round("window_error_rate", 6))


@CATALOG.add(
    f"""WITH {ev(TENANT)}, w AS (SELECT key, event_id, us, count(*) OVER x AS n, min(us) OVER x AS o
    FROM ev WINDOW x AS (PARTITION BY key ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW))
  SELECT key, event_id, n AS n_in_window, round(CASE WHEN us > o THEN n / ((us - o) / 1e6::DOUBLE) ELSE 0.0 END, 6) AS throughput_req_sec FROM w"""
)
def rolling_throughput(spark, folder):
    out = rolling.rolling_throughput(events(spark, folder, TENANT))
    return out.drop("ts").withColumn("throughput_req_sec", F.round("throughput_req_sec", 6))


def rolling_kl_sql() -> str:
    counts = ", ".join(f"count(*) FILTER (label = '{x}') OVER w AS n{i}" for i, x in enumerate(BASELINE))
    terms = " + ".join(f"{p}::DOUBLE * ln({p}::DOUBLE / greatest(n{i}::DOUBLE / n, 1e-6::DOUBLE))" for i, p in enumerate(BASELINE.values()))
    return f"""{ev(TENANT)}, c AS (SELECT key, event_id, ts, count(*) OVER w AS n, {counts} FROM ev
      WINDOW w AS (PARTITION BY key {ORDERED} ROWS BETWEEN 499 PRECEDING AND CURRENT ROW)),
    rk AS (SELECT key, event_id, ts, n, CASE WHEN n >= 100 THEN {terms} ELSE 0.0 END AS kl FROM c)"""


@CATALOG.add(f"WITH {rolling_kl_sql()} SELECT key, event_id, n AS n_predictions, round(kl, 6) AS kl, kl > 0.15 AS drift_detected FROM rk")
def rolling_kl_drift(spark, folder):
    out = rolling.rolling_drift(events(spark, folder, TENANT), BASELINE)
    return out.drop("ts").withColumn("kl", F.round("kl", 6))


@CATALOG.add(
    f"""WITH {ev()}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS k FROM ev)
  SELECT key, event_id, ts FROM r WHERE k <= 10"""
)
def keep_last_events(spark, folder):
    return plain_ts(rolling.keep_last(events(spark, folder).select("key", "event_id", "ts"), 10, KEY))


@CATALOG.add(
    f"""WITH {rolling_kl_sql()}, w AS (SELECT key, event_id, ts, count(*) FILTER (error) OVER x::DOUBLE / count(*) OVER x AS r
    FROM ev WINDOW x AS (PARTITION BY key {ORDERED} ROWS UNBOUNDED PRECEDING))
  SELECT key, ts, event_id, 'latency_spike' AS alert_type, round(latency_ms, 6) AS value FROM ev WHERE latency_ms > 300
  UNION ALL SELECT key, ts, event_id, 'error_spike', round(r, 6) FROM w WHERE r > 0.05
  UNION ALL SELECT key, ts, event_id, 'drift', round(kl, 6) FROM rk WHERE kl > 0.15""".replace("OVER x::DOUBLE", "OVER x * 1.0::DOUBLE")
)
def alerts(spark, folder):
    found = rolling.alerts(events(spark, folder, TENANT), BASELINE, policy=MonitorPolicy(latency_alert_ms=300.0))
    return plain_ts(found).withColumn("value", F.round("value", 6))


@CATALOG.add(
    f"""WITH {ev()}, w AS (SELECT key, event_id, ts, count(*) OVER x AS n, avg(confidence) OVER x AS c
    FROM ev WINDOW x AS (PARTITION BY key {ORDERED} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
  SELECT key, event_id, ts, round(c, 6) AS recent_confidence, round((0.8 - c) / 0.8, 6) AS degradation
  FROM w WHERE n = 10 AND (0.8 - c) / 0.8 > 0.15"""
)
def quality_degradation(spark, folder):
    out = rolling.quality_degradation(events(spark, folder))
    return plain_ts(out).select("key", "event_id", "ts", r6("recent_confidence"), r6("degradation"))


def breaker_sql(source: str = "ev", strict: bool = False, sticky: bool = False) -> str:
    """CTE ``walk`` of the breaker with threshold 2, timeout 6 h, 2 probe successes."""
    wait = 6 * 3600 * 1_000_000
    reopen = " OR (g = 'half_open')" if strict else ""
    ok_failures = "CASE WHEN g = 'half_open' AND s0 + 1 < 2 THEN f ELSE 0 END" if sticky else "0"
    return f"""seq AS (SELECT *, row_number() OVER (PARTITION BY key {ORDERED}) AS rn FROM {source}),
  walk(key, rn, event_id, ts, sb, allowed, sa, f, s, lf) AS (
    SELECT DISTINCT key, 0::BIGINT, NULL::BIGINT, NULL::TIMESTAMP, NULL::VARCHAR, NULL::BOOLEAN, 'closed', 0::BIGINT, 0::BIGINT, 0::BIGINT FROM seq
    UNION ALL
    SELECT key, rn, event_id, ts, sb, g <> 'open',
      CASE WHEN g = 'open' THEN 'open' WHEN error THEN CASE WHEN f + 1 >= 2{reopen} THEN 'open' ELSE g END
        WHEN g = 'half_open' AND s0 + 1 >= 2 THEN 'closed' ELSE g END,
      CASE WHEN g = 'open' THEN f WHEN error THEN f + 1 ELSE {ok_failures} END,
      CASE WHEN g = 'open' OR error OR g = 'closed' THEN s0 WHEN s0 + 1 >= 2 THEN 0 ELSE s0 + 1 END,
      CASE WHEN g <> 'open' AND error THEN us ELSE lf END
    FROM (SELECT q.key, q.rn, q.event_id, q.ts, q.us, q.error, w.sa AS sb, w.f, w.lf,
        CASE WHEN w.sa = 'open' AND q.us - w.lf >= {wait} THEN 'half_open' ELSE w.sa END AS g,
        CASE WHEN w.sa = 'open' AND q.us - w.lf >= {wait} THEN 0 ELSE w.s END AS s0
      FROM walk w JOIN seq q ON q.key = w.key AND q.rn = w.rn + 1))"""


BREAKER_COLUMNS = "key, event_id, ts, sb AS state_before, allowed, sa AS state_after"


@CATALOG.add(f"WITH RECURSIVE {ev()}, {breaker_sql()} SELECT {BREAKER_COLUMNS} FROM walk WHERE rn > 0")
def circuit_breaker_replay(spark, folder):
    return plain_ts(recovery.circuit_breaker(events(spark, folder), PATIENT))


@CATALOG.add(f"WITH RECURSIVE {ev()}, {breaker_sql(strict=True)} SELECT {BREAKER_COLUMNS} FROM walk WHERE rn > 0")
def circuit_breaker_strict(spark, folder):
    return plain_ts(recovery.circuit_breaker(events(spark, folder), PATIENT, strict=True))


@CATALOG.add(
    f"""WITH RECURSIVE {ev()}, {breaker_sql(sticky=True)} SELECT {BREAKER_COLUMNS},
  array_to_string([x FOR x IN [CASE WHEN sb = 'open' AND allowed THEN 'Circuit transitioned to HALF_OPEN' END,
    CASE WHEN allowed AND sa = 'open' THEN 'Circuit opened due to failure threshold'
      WHEN allowed AND sa = 'closed' AND sb <> 'closed' THEN 'Circuit closed after successful recovery' END] IF x IS NOT NULL], '; ') AS log
  FROM walk WHERE rn > 0"""
)
def circuit_breaker_sticky(spark, folder):
    out = recovery.circuit_breaker(events(spark, folder), PATIENT, variant="sticky", log=True)
    return plain_ts(out).withColumn("log", F.array_join("log", "; "))


@CATALOG.add(
    f"""WITH RECURSIVE {ev()}, {SNAPSHOT}, {breaker_sql()}, st AS (SELECT key, arg_max(sa, rn) AS circuit_state FROM walk WHERE rn > 0 GROUP BY key)
  SELECT key, CASE WHEN key % 10 <> 0 AND score > 50 THEN 'healthy' ELSE 'degraded' END AS status, request_count, round(r, 6) AS error_rate,
  circuit_state, least(100.0, greatest(0.0, (request_count * 2 - 60)::DOUBLE)) AS memory_percent FROM snap JOIN st USING (key)"""
)
def health_status(spark, folder):
    log = events(spark, folder)
    used = monitor.with_resources(monitor.health_snapshot(log, BASELINE, KEY), (F.col("request_count") * 2 - 60).cast("double"))
    states = recovery.circuit_states(recovery.circuit_breaker(log, PATIENT))
    found = monitor.health_status(used, F.col("key") % 10 != 0, breakers=states)
    return found.select("key", "status", "request_count", r6("error_rate"), "circuit_state", "memory_percent")


SINCE = "TIMESTAMP '2024-01-16 00:00:00'"


@CATALOG.add(
    f"""WITH RECURSIVE {ev()}, later AS (SELECT * FROM ev WHERE ts >= {SINCE}), {breaker_sql('later')}
  SELECT key, arg_max(sa, rn) AS circuit_state, count(*) FILTER (NOT allowed) AS n_rejected FROM walk WHERE rn > 0 GROUP BY key"""
)
def circuit_states_since_reset(spark, folder):
    """The breakers after a reset half-way through the log."""
    since = F.expr(SINCE)
    return recovery.circuit_states(recovery.circuit_breaker(events(spark, folder), PATIENT, since=since))


SPIKE_SQL = f"""seq2 AS (SELECT *, row_number() OVER (PARTITION BY key {ORDERED}) AS rn FROM ev),
  spike(key, rn, event_id, ts, c, fired) AS (
    SELECT DISTINCT key, 0::BIGINT, NULL::BIGINT, NULL::TIMESTAMP, 0::BIGINT, false FROM seq2 UNION ALL
    SELECT q.key, q.rn, q.event_id, q.ts,
      CASE WHEN latency_ms > {SPIKE_BASELINE}::DOUBLE * 2.5::DOUBLE THEN CASE WHEN w.c + 1 >= 10 THEN 0 ELSE w.c + 1 END ELSE greatest(0, w.c - 1) END,
      latency_ms > {SPIKE_BASELINE}::DOUBLE * 2.5::DOUBLE AND w.c + 1 >= 10
    FROM spike w JOIN seq2 q ON q.key = w.key AND q.rn = w.rn + 1)"""


@CATALOG.add(f"WITH RECURSIVE {ev(TENANT)}, {SPIKE_SQL} SELECT key, event_id, ts, CAST(c AS INTEGER) AS spike_count, fired FROM spike WHERE rn > 0")
def latency_spikes(spark, folder):
    samples = events(spark, folder, TENANT)
    return plain_ts(recovery.latency_spikes(samples, F.col("latency_ms"), F.lit(SPIKE_BASELINE), PATIENT))


COOL_SQL = f"""bad AS (SELECT *, row_number() OVER (PARTITION BY key {ORDERED}) AS rn FROM ev WHERE error),
  cool(key, rn, event_id, ts, taken, last, n) AS (
    SELECT DISTINCT key, 0::BIGINT, NULL::BIGINT, NULL::TIMESTAMP, false, NULL::BIGINT, 0::BIGINT FROM bad UNION ALL
    SELECT q.key, q.rn, q.event_id, q.ts, w.last IS NULL OR q.us - w.last >= 21600000000,
      CASE WHEN w.last IS NULL OR q.us - w.last >= 21600000000 THEN q.us ELSE w.last END,
      w.n + CASE WHEN w.last IS NULL OR q.us - w.last >= 21600000000 THEN 1 ELSE 0 END
    FROM cool w JOIN bad q ON q.key = w.key AND q.rn = w.rn + 1),
  cut AS (SELECT key, event_id, ts, CAST(greatest(1, 32 >> CAST(least(n - 1, 10) AS INTEGER)) AS INTEGER) AS old_batch_size,
    CAST(greatest(1, 32 >> CAST(least(n, 10) AS INTEGER)) AS INTEGER) AS new_batch_size FROM cool WHERE taken)"""


@CATALOG.add(f"WITH RECURSIVE {ev()}, {COOL_SQL} SELECT * FROM cut")
def batch_reduction(spark, folder):
    log = events(spark, folder)
    return plain_ts(recovery.batch_reduction(log.where("error"), PATIENT))


HISTORY_SQL = f"""WITH RECURSIVE {ev()}, {SPIKE_SQL}, {COOL_SQL},
  q10 AS (SELECT key, event_id, ts, count(*) OVER x AS n, avg(confidence) OVER x AS c FROM ev
    WINDOW x AS (PARTITION BY key {ORDERED} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
  act AS (SELECT key, event_id, ts, 'model_reload_quality' AS action_type FROM q10 WHERE n = 10 AND (0.8 - c) / 0.8 > 0.15
    UNION ALL SELECT key, event_id, ts, 'quantized_model_switch' FROM spike WHERE fired
    UNION ALL SELECT key, event_id, ts, 'batch_size_reduction' FROM cut)"""


@CATALOG.add(HISTORY_SQL + " SELECT key::VARCHAR AS key, event_id, ts, action_type FROM act ORDER BY ts DESC, event_id DESC, action_type DESC LIMIT 100")
def recovery_history(spark, folder):
    actions = recovery.detect_all(events(spark, folder), SPIKE_BASELINE, PATIENT)
    return plain_ts(recovery.recovery_history(actions)).select("key", "event_id", "ts", "action_type")


@CATALOG.add(HISTORY_SQL + " SELECT action_type, count(*) AS n FROM act GROUP BY action_type")
def recovery_audit_log(spark, folder):
    """The audit table after the same actions were appended twice."""
    actions = recovery.detect_all(events(spark, folder), SPIKE_BASELINE, PATIENT)
    path = scratch_path(spark, "audit")
    sinks.append_actions(actions, path)
    sinks.append_actions(actions, path)
    return sinks.read_actions(spark, path).groupBy("action_type").agg(F.count(F.lit(1)).alias("n"))


# --- streams -------------------------------------------------------------------

RAW_EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
RAW_DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def stream_of(spark, folder: str, name: str, schema: T.StructType):
    return stream_files(use_utc(spark), f"{folder}/{name}.parquet", schema)


def event_stream(spark, folder, key: str = "user_id"):
    return as_events(stream_of(spark, folder, "events", RAW_EVENTS), key)


WEEK_US = 7 * 24 * 3600 * 1_000_000
STREAM_SCORE = SCORE.replace("r * 500", "error_rate * 500").replace("t < 1.0", "thr < 1.0").replace("::DOUBLE - t)", "::DOUBLE - thr)")


@CATALOG.add(
    f"""WITH {ev(TENANT)}, {baseline_sql()}, g AS (SELECT key, us // {WEEK_US} AS w, count(*) AS n, count(*) FILTER (error) AS error_count,
    list_sort(list(latency_ms)) AS s, list(label) AS labels, avg(latency_ms) AS m FROM ev GROUP BY key, w),
  q AS (SELECT key, w, sum(p * ln(p / greatest(len(list_filter(labels, lambda x: x = label))::DOUBLE / n, 1e-6::DOUBLE))) AS kl FROM g, bl GROUP BY key, w),
  f AS (SELECT key, w, n, error_count, error_count::DOUBLE / n AS error_rate, n / 604800.0::DOUBLE AS thr,
    s[least(CAST(floor(n * 50.0::DOUBLE / 100) AS BIGINT) + 1, n)] AS p50, s[least(CAST(floor(n * 95.0::DOUBLE / 100) AS BIGINT) + 1, n)] AS p95,
    s[least(CAST(floor(n * 99.0::DOUBLE / 100) AS BIGINT) + 1, n)] AS p99, s[1] AS latency_min, s[n] AS latency_max, m,
    CASE WHEN n >= 100 THEN kl ELSE 0.0 END AS kl FROM g JOIN q USING (key, w))
  SELECT key, make_timestamp(w * {WEEK_US}) AS window_start, n AS request_count, error_count, round(error_rate, 6) AS error_rate,
    round(thr, 9) AS throughput_req_sec, p50, p95, p99, latency_min, latency_max, round(m + 1e-9, 6) AS latency_mean, round(kl, 6) AS kl,
    kl > 0.15 AS drift_detected, round({STREAM_SCORE}, 6) AS health_score FROM f"""
)
def stream_metrics(spark, folder):
    windows = jobs.exact_metric_windows(event_stream(spark, folder, TENANT), BASELINE, "7 days")
    return plain_ts(windows, "window_start").select(
        "key", "window_start", "request_count", "error_count", r6("error_rate"),
        F.round("throughput_req_sec", 9).alias("throughput_req_sec"), "p50", "p95", "p99", "latency_min", "latency_max",
        steady("latency_mean"), r6("kl"), "drift_detected", r6("health_score"),
    )


@CATALOG.add(f"WITH RECURSIVE {ev()}, {breaker_sql()} SELECT {BREAKER_COLUMNS} FROM walk WHERE rn > 0")
def stream_breaker(spark, folder):
    return plain_ts(recovery.gated(jobs.breaker_stream(event_stream(spark, folder), PATIENT).rows))


@CATALOG.add(
    f"""WITH {ev()}, w AS (SELECT key, event_id, ts, count(*) OVER x AS n, avg(confidence) OVER x AS c
    FROM ev WINDOW x AS (PARTITION BY key {ORDERED} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
  SELECT key, event_id, ts, round(c, 6) AS recent_confidence, round((0.8 - c) / 0.8, 6) AS degradation
  FROM w WHERE n = 10 AND (0.8 - c) / 0.8 > 0.15"""
)
def stream_quality(spark, folder):
    out = jobs.quality_stream(event_stream(spark, folder)).rows
    return plain_ts(out).select("key", "event_id", "ts", r6("recent_confidence"), r6("degradation"))


@CATALOG.add(
    f"""WITH {ev(TENANT)}, w AS (SELECT key, event_id, ts, count(*) OVER x AS n, count(*) FILTER (error) OVER x AS e
    FROM ev WINDOW x AS (PARTITION BY key {ORDERED} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
  SELECT key, event_id, ts, round(e / 100.0::DOUBLE, 6) AS window_error_rate FROM w WHERE n = 100 AND e / 100.0::DOUBLE > 0.05"""
)
def stream_error_spikes(spark, folder):
    out = jobs.error_spike_stream(event_stream(spark, folder, TENANT), SENSITIVE).rows
    return plain_ts(out).select("key", "event_id", "ts", r6("window_error_rate"))


@CATALOG.add(f"WITH RECURSIVE {ev(TENANT)}, {SPIKE_SQL} SELECT key, event_id, ts, CAST(c AS INTEGER) AS spike_count, fired FROM spike WHERE rn > 0")
def stream_spikes(spark, folder):
    folded = jobs.spike_stream(event_stream(spark, folder, TENANT), F.col("latency_ms"), F.lit(SPIKE_BASELINE), PATIENT)
    return plain_ts(recovery.counted_spikes(folded.rows, PATIENT))


@CATALOG.add(f"WITH RECURSIVE {ev()}, {COOL_SQL} SELECT * FROM cut")
def stream_cooldown(spark, folder):
    folded = jobs.cooldown_stream(event_stream(spark, folder).where("error"), PATIENT)
    return plain_ts(recovery.reduced(folded.rows, PATIENT))


@CATALOG.add(HISTORY_SQL + " SELECT key::VARCHAR AS key, event_id, ts, action_type FROM act")
def stream_audit(spark, folder):
    """The audit log that the detectors' streams wrote."""
    log = jobs.audit_stream(event_stream(spark, folder), SPIKE_BASELINE, scratch_path(spark, "audit-log"), PATIENT)
    return plain_ts(log).select("key", "event_id", "ts", "action_type")


SLOW = MonitorPolicy(latency_alert_ms=20.0)


@CATALOG.add(
    f"""WITH {ev()} SELECT key, event_id, ts, 'latency_spike' AS alert_type, latency_ms AS value, true AS stamped FROM ev WHERE latency_ms > 20"""
)
def stream_alert_hook(spark, folder):
    """What a hook that files every alert was handed."""
    path = scratch_path(spark, "alerts")

    def file_alerts(rows, number):
        rows.write.mode("overwrite").parquet(f"{path}/part={number}")

    found = jobs.alert_stream(event_stream(spark, folder), SLOW)
    jobs.on_alerts(found, file_alerts).awaitTermination()
    stamped = F.col("raised_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}\+00:00$")
    rows = spark.read.schema(found.schema).parquet(f"{path}/part=*")
    return plain_ts(rows).select("key", "event_id", "ts", "alert_type", "value", stamped.alias("stamped"))


@CATALOG.add(
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents)
  SELECT doc_id, k // 32 AS batch_id, k % 32 AS position FROM r"""
)
def stream_batches(spark, folder):
    return folds.batched_stream(stream_of(spark, folder, "documents", RAW_DOCUMENTS), DEFAULT_BATCH_SIZE).rows


@CATALOG.add(f"WITH {ev()}, {tail_sql('ev')} SELECT key, {TAIL} FROM tail")
def stream_latency(spark, folder):
    """The newest row of each key that the stream wrote."""
    rows = jobs.run_to_table(jobs.latency_stream(event_stream(spark, folder)))
    newest = rows.groupBy("key").agg(F.max_by(F.struct("p50", "p95", "p99", "min", "max", "mean"), "n_seen").alias("m"))
    return newest.select("key", "m.*").withColumn("mean", steady("mean"))


@CATALOG.add(
    f"""WITH {ev()}, {baseline_sql()}, d AS (SELECT *, date_trunc('day', ts) AS day FROM ev),
  tot AS (SELECT day, count(*) AS n FROM d GROUP BY day),
  q AS (SELECT t.day, t.n, b.p, greatest((SELECT count(*) FROM d r WHERE r.day = t.day AND r.label = b.label)::DOUBLE / t.n, 1e-6::DOUBLE) AS q FROM tot t, bl b)
  SELECT day AS window_start, n AS n_predictions, round(CASE WHEN n >= 100 THEN sum(p * ln(p / q)) ELSE 0.0 END, 6) AS kl FROM q
  GROUP BY day, n"""
)
def stream_drift(spark, folder):
    """Daily drift against a baseline table that was written beforehand."""
    path = scratch_path(spark, "baseline")
    spark.createDataFrame(list(BASELINE.items()), "label string, p double").write.parquet(path)
    baseline = spark.read.parquet(path)
    counts = jobs.drift_windows(event_stream(spark, folder), baseline, "1 day", watermark=None)
    counts = jobs.run_to_latest(counts, ["window_start", "label"])
    drift = jobs.window_drift(counts, baseline)
    return plain_ts(drift, "window_start").select("window_start", "n_predictions", r6("kl"))


def _stream_verdict_sql():
    from textvane.catalog.corpus_queries import VERDICT_SQL

    return VERDICT_SQL


@CATALOG.add(_stream_verdict_sql())
def stream_guardrails(spark, folder):
    from textvane.catalog.corpus_queries import verdict_columns

    raw = stream_of(spark, folder, "documents", RAW_DOCUMENTS)
    names = F.array(*[F.lit(x) for x in ("negative", "neutral", "positive", "other")])
    predicted = raw.select(
        "doc_id",
        "text",
        F.get(names, (F.col("n_chars") % 4).cast("int")).alias("label"),
        ((F.col("n_chars") * 7 + F.col("doc_id")) % 101 / 100.0).alias("confidence"),
    )
    return verdict_columns(jobs.run_to_table(jobs.guardrail_stream(predicted, stamp=False)))

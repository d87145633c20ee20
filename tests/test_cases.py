"""Small hand-made cases of the expressions and aggregates."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from textvane.config import RecoveryPolicy
from textvane.functions.pii import with_redaction
from textvane.functions.scores import argmax_index, encode_label, top_score
from textvane.functions.text import clean_basic, clean_text, is_blank
from textvane.operators import batching, evaluation, guardrails, monitor, quality, recovery, rolling, sampling, scoring
from textvane.operators.validation import split_requests
from textvane.plans.preprocess import preprocess, stage_stats
from textvane.sources import sinks
from textvane.sources.corpus import cache_to_disk
from textvane.sources.events import with_defaults

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
EDGE_SPACES = "\u0085  \x1c\x1d\x1e\x1f"


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


def column(df, name):
    return [r[name] for r in df.orderBy("doc_id").collect()]


def test_blank(spark):
    df = texts(spark, "ok", "", "   ", "\t\n", None, EDGE_SPACES, "a ")
    assert column(df.withColumn("b", is_blank(F.col("text"))), "b") == [False, True, True, True, True, True, False]


def test_clean(spark):
    df = texts(
        spark, "  Hello\x00  \t\n  World  ", None, EDGE_SPACES, "itâ\u0080\u0099s â\u0080\u009cxâ\u0080\u009d", "a\rb"
    )
    assert column(df.withColumn("c", clean_text(F.col("text"))), "c") == ["Hello World", "", "", "it's \"x\"", "a b"]
    assert column(df.withColumn("c", clean_basic(F.col("text"))), "c")[0] == "Hello World"
    assert column(df.withColumn("c", clean_basic(F.col("text"))), "c")[4] == "ab"


PII_CASES = [
    ("SSN 123-45-6789", "SSN [REDACTED_SSN]", ["ssn"]),
    ("card 1234-5678-9012-3456.", "card [REDACTED_CREDIT_CARD].", ["credit_card"]),
    ("1234567890123456", "[REDACTED_CREDIT_CARD]", ["credit_card"]),
    ("1234567890", "[REDACTED_PHONE]", ["phone"]),
    ("123456789", "[REDACTED_ACCOUNT_NUMBER]", ["account_number"]),
    ("123456789012345678", "123456789012345678", []),
    ("(743) 555-3824", "([REDACTED_PHONE]", ["phone"]),
    ("a@b.co and 123-45-6789", "[REDACTED_EMAIL] and [REDACTED_SSN]", ["ssn", "email"]),
    ("١٢٣-٤٥-٦٧٨٩", "[REDACTED_SSN]", ["ssn"]),
    ("é123456789", "é123456789", []),
    ("nothing here", "nothing here", []),
    (None, None, []),
]


def test_redaction(spark):
    out = with_redaction(texts(spark, *[c[0] for c in PII_CASES])).orderBy("doc_id").collect()
    assert [(r.text, r.redacted_text, r.pii_detected) for r in out] == PII_CASES


def test_guardrails(spark):
    rows = [("fine", "positive", 0.95), ("id 123-45-6789", "neutral", 0.9), ("hm", "positive", 0.3), ("x", "positive", 0.7), ("x", "bad", 0.9)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, label string, confidence double")
    out = guardrails.apply_guardrails(df).orderBy("doc_id").collect()
    assert [r.passed for r in out] == [True, True, False, True, False]
    assert out[1].pii_detected == ["ssn"] and out[2].flags == ["LOW_CONFIDENCE: 0.300 < 0.7"]
    assert out[4].flags == ["INVALID_LABEL: 'bad' not in ['negative', 'neutral', 'positive']"]


def test_requests(spark):
    rows = [(1, "ok", None), (2, "ok", 0.9), (3, "", 0.5), (4, "ok", 1.5), (5, "ok", -0.1), (6, "x" * 2049, 0.5), (7, None, 0.5)]
    good, bad = split_requests(spark.createDataFrame(rows, "req_id long, text string, confidence_threshold double"))
    assert {r.req_id: r.confidence_threshold for r in good.collect()} == {1: 0.7, 2: 0.9}
    assert {r.req_id for r in bad.collect()} == {3, 4, 5, 6, 7}


def test_scores(spark):
    one = spark.range(1).select(
        encode_label(F.lit("neutral")).alias("a"), encode_label(F.lit("?")).alias("b"),
        argmax_index(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))).alias("c"),
        top_score(F.array(*[F.struct(F.lit(n).alias("label"), F.lit(s).alias("score")) for n, s in (("x", 0.4), ("y", 0.4), ("z", 0.2))]))["label"].alias("d"),
    ).first()
    assert tuple(one) == (1, -1, 1, "x")


def labelled(spark, labels):
    return spark.createDataFrame(list(enumerate(labels)), "doc_id long, label string")


@pytest.mark.parametrize(
    "labels,ratio,balanced,top,low",
    [("", 0.0, True, None, None), ("A" * 11 + "B", 11.0, False, "A", "B"), ("A" * 10 + "B", 10.0, True, "A", "B"), ("BAAB", 1.0, True, "B", "B")],
)
def test_label_distribution(spark, labels, ratio, balanced, top, low):
    row = quality.label_distribution(labelled(spark, list(labels))).first()
    assert (row.imbalance_ratio, row.is_balanced, row.max_class, row.min_class) == (ratio, balanced, top, low)


def test_lengths(spark):
    row = quality.length_stats(texts(spark, *["x" * n for n in range(1, 21)])).first()
    assert (row.median_length, row.percentile_length, row.outlier_count, row.mean_length) == (11, 20, 0, 10.5)
    empty = quality.length_stats(texts(spark, "x").where("false")).first()
    assert set(empty.asDict().values()) == {0}


def test_sampling(spark):
    df = labelled(spark, ["A"] * 70 + ["B"] * 30)
    sample = sampling.stratified_size(df, 20)
    assert {r.label: r["count"] for r in sample.groupBy("label").count().collect()} == {"A": 14, "B": 6}
    assert sampling.ratio_preserved(df, sample, 0.15).first().preserved
    assert not sampling.ratio_preserved(df, df.where("label = 'A'")).first().preserved
    assert sampling.stratified_size(labelled(spark, "AAB"), 10).count() == 3
    assert sampling.stratified_fraction(labelled(spark, "AAAAAAAAAB"), 0.1).count() == 2


def test_split(spark):
    split = sampling.train_test_split(labelled(spark, ["A"] * 53 + ["B"] * 29 + ["C"]))
    assert split.count() == 83 and split.select("doc_id").distinct().count() == 83
    sizes = {(r.label, r.split): r["count"] for r in split.groupBy("label", "split").count().collect()}
    assert sum(n for (_, s), n in sizes.items() if s == "test") == 17 and sizes["A", "test"] == 11


def test_batches(spark):
    sizes = [r.n_rows for r in batching.batch_sizes(batching.batch_positions(spark.range(70).withColumnRenamed("id", "doc_id"))).orderBy("batch_id").collect()]
    assert sizes == [32, 32, 6]
    got = [[r.doc_id for r in b] for b in batching.iterate_batches(texts(spark, *"abcde"), 2)]
    assert got == [[0, 1], [2, 3], [4]]
    assert batching.batch_size_for_budget(texts(spark, "x").where("false"), 100).first().batch_size == 32


def log(spark, latencies, **extra):
    rows = [(i, T0 + timedelta(seconds=i), "k", float(x)) for i, x in enumerate(latencies)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, key string, latency_ms double")
    for name, value in extra.items():
        df = df.withColumn(name, value)
    return with_defaults(df)


def test_percentiles(spark):
    one = monitor.latency_percentiles(log(spark, [7])).first()
    assert (one.p50, one.p99, one.mean) == (7, 7, 7)
    row = monitor.latency_percentiles(log(spark, range(1, 101)), ["key"]).first()
    assert (row.p50, row.p95, row.p99) == (51, 96, 100)
    line = monitor.linear_percentiles(log(spark, range(1, 101))).first()
    assert (line.p50, round(line.p95, 9), round(line.p99, 9)) == (50.5, 95.05, 99.01)
    assert monitor.latency_percentiles(log(spark, [1]).where("false")).first().p50 == 0


def test_error_rate_may_exceed_one(spark):
    kinds = ["request"] * 2 + ["error"] * 3
    df = log(spark, [1] * 5, kind=F.get(F.array(*[F.lit(k) for k in kinds]), F.col("event_id").cast("int")))
    assert monitor.error_rate(df).first().error_rate == 1.5
    assert monitor.error_rate(df.where("kind = 'error'")).first().error_rate == 0


@pytest.mark.parametrize("n,active", [(99, False), (100, True)])
def test_drift(spark, n, active):
    df = log(spark, [1] * n, label=F.lit("a"))
    row = monitor.kl_drift(df, {"a": 0.5, "b": 0.5}).first()
    assert (row.kl > 0) == active and row.drift_detected == active


def test_health_scores(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 0.0), (0.05, 100.0, 1.0), (0.2, 600.0, 0.0)], "e double, p double, t double")
    assert sorted(r[0] for r in rows.select(monitor.health_score(F.col("e"), F.col("p"), F.col("t"))).collect()) == [0, 75, 75]


def test_mean_shift_and_linear_health(spark):
    assert not monitor.mean_shift(log(spark, [99, 101, 100.5, 99.5]), 100.0).first().drifted
    assert monitor.mean_shift(log(spark, [150, 155, 160, 165]), 100.0).first().drifted
    assert not monitor.mean_shift(log(spark, [1]).where("false"), 100.0).first().drifted
    bad = log(spark, [1] * 5, error=F.lit(True))
    assert monitor.linear_health(bad).first().health == 0.5


def test_keep_last(spark):
    assert sorted(r.event_id for r in rolling.keep_last(log(spark, range(150)), 100).collect()) == list(range(50, 150))


def test_quality_alert(spark):
    assert rolling.quality_degradation(log(spark, [1] * 9, confidence=F.lit(0.1), label=F.lit("a"))).count() == 0
    alert = rolling.quality_degradation(log(spark, [1] * 10, confidence=F.lit(0.6), label=F.lit("a"))).first()
    assert round(alert.degradation, 9) == 0.25


def test_cooldown(spark):
    df = log(spark, [1] * 3).withColumn("ts", (F.col("ts").cast("long") + F.col("event_id") * 29).cast("timestamp"))
    out = recovery.batch_reduction(df).orderBy("event_id").collect()
    assert [(r.event_id, r.old_batch_size, r.new_batch_size) for r in out] == [(0, 32, 16), (2, 16, 8)]


def test_breaker_log(spark):
    df = log(spark, [1] * 6, error=F.col("event_id") < 3)
    policy = RecoveryPolicy(failure_threshold=3, recovery_timeout_sec=0.0)
    said = [m for r in recovery.circuit_breaker(df, policy, variant="sticky", log=True).orderBy("event_id").collect() for m in r.log]
    assert any("opened" in m for m in said) and any("HALF_OPEN" in m for m in said) and any("closed" in m for m in said)


def test_evaluation_with_an_unpredicted_class(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "true_label string, pred_label string")
    matrix = evaluation.confusion_matrix(df)
    assert matrix.count() == 9
    b = evaluation.per_class_metrics(matrix).where("label = 'b'").first()
    assert (b.precision, b.recall, b.f1, b.support) == (0, 0, 0, 1)


def test_scoring_isolates_failures(spark):
    def failing_loader():
        def score(batch):
            if "boom" in batch:
                raise ValueError("boom")
            return [[{"label": "positive", "score": 0.9}] for _ in batch]

        return score

    out = scoring.verdicts(scoring.score_rows(texts(spark, "x", "boom", "y"), failing_loader)).orderBy("doc_id").collect()
    assert [(r.label, r.confidence, r.passed) for r in out] == [("positive", 0.9, True), ("error", 0.0, False), ("positive", 0.9, True)]
    assert out[1].flags == ["INFERENCE_ERROR: boom"]


def test_stage_stats_and_preprocess(spark):
    df = texts(spark, "one", "two", " ", "three", "ONE ")
    row = stage_stats(df).first()
    assert (row.total, row.validation_failures, row.after_validation, row.duplicates_removed, row.after_cleaning) == (5, 1, 4, 1, 3)
    kept = preprocess(texts(spark, "a  b", "", None, "a b", "c"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 4]


def test_sinks(spark, tmp_path):
    with pytest.raises(ValueError):
        cache_to_disk(texts(spark, "x"), str(tmp_path / "c"), "pickle")
    rows = spark.createDataFrame([("k", T0, "x", "why", True, {"a": "1"})], "key string, ts timestamp, action_type string, reason string, success boolean, details map<string,string>")
    for _ in range(2):
        sinks.append_actions(rows, str(tmp_path / "audit"))
    assert sinks.read_actions(spark, str(tmp_path / "audit")).count() == 1

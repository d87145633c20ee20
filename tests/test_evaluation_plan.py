"""Held-out evaluation and the timing of baselines."""

import statistics

import pytest

from textvane.operators import models, scoring
from textvane.operators.sampling import train_test_split
from textvane.plans.evaluation import evaluate_held_out


@pytest.fixture
def load_scorer():
    def load():  # a function of a module of tests could not be found by the workers
        def score(texts):
            if any(t == "bad" for t in texts):
                raise ValueError("no")
            return [[{"label": "positive" if "good" in t else "negative", "score": 0.9}] for t in texts]

        return score

    return load


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, f"good thing {i}" if i % 2 else f"poor thing {i}", "positive" if i % 2 else "negative") for i in range(60)]
    rows += [(100 + i, "bad", "neutral") for i in range(10)]
    return spark.createDataFrame(rows, "doc_id long, text string, label string")


def test_only_the_test_part_is_scored(corpus, load_scorer):
    split = train_test_split(corpus)
    found = evaluate_held_out(split, load_scorer)
    test = {r.label: r["count"] for r in split.where("split = 'test'").groupBy("label").count().collect()}
    report = {r.label: r for r in found.report.collect()}
    assert found.latency.first().total_samples == sum(test.values()) < corpus.count()
    assert {k: report[k].support for k in test} == test
    assert report["positive"].f1 == report["negative"].f1 == 1.0 and report["neutral"].recall == 0.0
    cells = {(r.true_label, r.pred_label): r.n for r in found.matrix.where("n > 0").collect()}
    assert cells["neutral", "error"] == test["neutral"]
    times = found.latency.first()
    assert 0 < times.p50 <= times.p95 <= times.p99


def test_timed_rows_equal_batched_rows(corpus, load_scorer):
    pick = ["doc_id", "scores", "score_error"]
    single = scoring.score_rows(corpus, load_scorer, timed=True)
    assert single.where("latency_ms > 0").count() == corpus.count()
    assert sorted(map(str, single.select(*pick).collect())) == sorted(map(str, scoring.score_rows(corpus, load_scorer).select(*pick).collect()))


def test_baselines_report_times_and_latencies(spark, corpus):
    split = train_test_split(corpus)
    found = models.run_baselines(split, ("logreg", "svm")).collect()
    for name in ("tfidf_logreg", "tfidf_svm"):
        said = {r.metric: r.value for r in found if r.model == name and r["class"] is None}
        assert said["training_time_seconds"] > 0 and said["support"] == split.where("split = 'test'").count()
        assert said["latency_min_ms"] <= said["latency_median_ms"] <= said["latency_max_ms"]
        assert said["accuracy"] > 0.8


def test_latency_metrics():
    spent = [3.0, 1.0, 2.0]
    said = models.latency_metrics(spent)
    assert said["latency_mean_ms"] == 2.0 and said["latency_std_ms"] == statistics.pstdev(spent)
    assert models.latency_metrics([]) == {}

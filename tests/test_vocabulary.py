"""The vocabulary from summaries equals the one from counting every term."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textvane.operators import features


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(6)
    words = [f"w{int(rng.paretovariate(0.6)) % 4000}" for _ in range(20_000)]
    rows = [(i, " ".join(words[i * 40 : i * 40 + 40])) for i in range(480)] + [(1000, None), (1001, ""), (1002, "alone")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(6).persist()


def slow(texts, most, min_df=2, share=0.95):
    df, cf, n = Counter(), Counter(), 0
    for r in texts.collect():
        words = (r.text or "").split()
        terms = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        cf.update(terms)
        df.update(set(terms))
        n += 1
    kept = [(t, df[t], cf[t]) for t in cf if min_df <= df[t] <= share * n]
    return sorted(kept, key=lambda x: (-x[2], x[0]))[:most]


@pytest.mark.parametrize("most,size", [(20, 1 << 18), (20, 300), (20, 10), (5, 200), (10**6, 1 << 18), (10**6, 50)])
def test_any_size_of_the_summaries(texts, most, size):
    """Large summaries, small ones that need the bound, and ones too small, where every term is counted."""
    found = features.vocabulary(texts, F.lit(texts.count()), most, size=size)
    assert sorted(map(tuple, found.collect()), key=lambda x: (-x[2], x[0])) == slow(texts, most)


@pytest.mark.parametrize("size", [5, 50, 5000])
def test_summary_bounds(texts, size):
    cf = Counter()
    for r in texts.collect():
        words = (r.text or "").split()
        cf.update(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    rows = {r.term: r.n for r in features.term_summary(texts, size=size).collect()}
    missing = rows.pop(None)
    assert all(rows.get(t, 0) <= n <= rows.get(t, 0) + missing for t, n in cf.items())
    assert len(rows) <= size * texts.rdd.getNumPartitions()


def test_candidates_suffice_where_terms_are_frequent(texts, monkeypatch):
    """The exact count of all terms is not needed."""
    monkeypatch.setattr(features, "term_counts", None)
    assert features.vocabulary(texts, F.lit(texts.count()), 5, size=400).count() == 5


def test_no_texts(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert features.vocabulary(none, F.lit(0)).collect() == []


def long_documents(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 500}" for _ in range(n))) for i, n in enumerate([0, 1, 2, 900, 31, 32, 33, 63, 64, 65, 2000, 5])]
    return spark.createDataFrame([*rows, (100, None)], "doc_id long, text string").coalesce(1)


def test_a_row_for_python_holds_few_terms(spark):
    """What a worker gets at once does not follow from the length of the documents."""
    worded = features.with_terms(long_documents(spark).select("doc_id", "text"))
    whole = {r.doc_id: r.terms for r in worded.collect()}
    rows = features.term_rows(worded.select("doc_id", "terms")).collect()
    assert max(len(r.terms or []) for r in rows) == features.TERMS_PER_ROW
    back = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r["_at"])):
        back.setdefault(r.doc_id, []).extend(r.terms or [])
    assert back == {i: terms or [] for i, terms in whole.items()}


@pytest.mark.parametrize("at_once", [1, 3, 10_000])
def test_documents_that_go_on_in_the_next_batch(spark, at_once):
    texts = long_documents(spark)
    expected = {}
    n, known = texts.count(), {t: df for t, df, _ in slow(texts, 40)}
    for r in texts.collect():
        words = (r.text or "").split()
        tf = Counter(t for t in words + [f"{a} {b}" for a, b in zip(words, words[1:])] if t in known)
        weights = {t: c * (math.log((n + 1) / (known[t] + 1)) + 1) for t, c in tf.items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        expected |= {(r.doc_id, t): w / norm for t, w in weights.items()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(at_once))
    try:
        found = features.tfidf_weights(texts, max_terms=40).collect()
        counted = features.vocabulary(texts, F.lit(n), 40).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {(r.doc_id, r.term): r.weight for r in found} == pytest.approx(expected)
    assert sorted(map(tuple, counted), key=lambda x: (-x[2], x[0])) == slow(texts, 40)

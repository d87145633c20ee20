import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textvane.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<float>, id int, bits string, anchor int, score string"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "b", 2, "s") for r in rows], SCHEMA)


def brute(rows, every, k=5, m=5):
    live = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        live.append((i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for a, label, v in (r for r in live if r[0] % every == 0):
        scored = [(-sum(x * y for x, y in zip(v, w)), i, kind) for i, kind, w in live if i != a]
        scored.sort()
        for s, i, _ in [x for x in scored if x[2] == label][:k]:
            far = [x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:m]
            out += [(a, i, r, x[1], -s, -x[0]) for r, x in enumerate(far, 1)]
    return sorted(out)


def found(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


@pytest.mark.parametrize("width,wide", [(16, 0.4), (13, 3.0), (64, 0.1)])
def test_against_brute_force(spark, monkeypatch, width, wide):
    monkeypatch.setattr(hn, "BLOCK", 97)
    monkeypatch.setattr(hn, "CHUNK", 7)
    random = np.random.default_rng(width)
    rows = [(i, int(random.integers(4)), [float(x) for x in np.float32(random.normal(size=width) * wide)]) for i in range(600)]
    for i in range(0, 600, 3):  # a third are copies of one vector
        rows[i] = (i, i % 4, rows[0][2])
    got = found(hn.hard_negatives(frame(spark, rows).repartition(4), F.col("id") % 20 == 0))
    assert got == brute(rows, 20) and got


def test_odd_rows(spark):
    rows = [
        (0, 1, [0.5, 0.25]), (1, 1, [0.5, 0.2]), (2, 1, [0.5]), (3, 2, [0.5, 0.2]), (4, 2, [0.5, 0.2, 0.9]), (5, 2, None), (6, None, [0.5, 0.2]),
        (7, 2, [NAN, 1.0]), (8, 2, [INF, 1.0]), (9, 2, [None, 1.0]), (10, 2, []), (11, 2, [0.0, 0.0]), (None, 2, [0.5, 0.2]), (12, 2, [0.5, 0.2]),
        (100, 3, [0.0, 0.0]), (13, 3, [1.0, 1.0]), (200, 4, [1.0]), (300, 1, [-1.0, -1.0]),
    ]
    got = found(hn.hard_negatives(frame(spark, rows), F.col("id") % 100 == 0))
    assert got == brute(rows, 100)
    assert {g[0] for g in got} == {0, 100}  # all rows score 0 with the zero vector


def test_repeated_rows_and_ids(spark):
    """A row under the anchor's id is no candidate; other repeated rows count each."""
    rows = [(0, 1, [1.0]), (0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.9]), (2, 2, [0.9])]
    got = found(hn.hard_negatives(frame(spark, rows), F.col("id") == 0))
    one = [(0, 1, 1, 2, 65536, 58880), (0, 1, 2, 2, 65536, 58880)]
    assert got == sorted(one + one)


def test_empty_and_without_anchors(spark):
    assert hn.hard_negatives(frame(spark, []), F.col("id") == 0).collect() == []
    assert hn.hard_negatives(frame(spark, [(1, 1, [1.0])]), F.col("id") == 0).collect() == []
    assert hn.hard_negatives(frame(spark, [(0, 1, [1.0]), (1, 2, [1.0])]), F.col("id") == 0).collect() == []


def test_labels_must_be_integers(spark):
    odd = spark.createDataFrame([(0, "a", [1.0])], "vec_id long, label string, embedding array<float>")
    with pytest.raises(TypeError):
        hn.hard_negatives(odd, F.col("id") == 0)


@pytest.mark.parametrize("planes,dims", [(1, 8), (10, 24), (33, 16), (64, 8)])
def test_scores_are_inner_products(monkeypatch, planes, dims):
    monkeypatch.setattr(hn, "TILE", 17)
    random = np.random.default_rng(planes)
    half = 1 << (planes - 1)
    rows = random.integers(-half, half, (50, dims), endpoint=False, dtype=np.int64)
    anchors = random.integers(-half, half, (9, dims), endpoint=False, dtype=np.int64)
    tables = hn.subset_sums(anchors, hn._narrowest(anchors, planes))
    assert np.array_equal(hn.score(hn.bit_planes(rows, planes), tables), anchors @ rows.T)  # both wrap alike

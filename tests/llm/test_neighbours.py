import numpy as np
import pytest
from pyspark.sql import functions as F

from textvane.llm import neighbours


def brute(ids, matrix, queries, k):
    out = {}
    for q in queries:
        scores = matrix @ matrix[ids.index(q)]
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-scores[i], ids[i]))[:k]
        out[q] = [(ids[i], float(scores[i])) for i in order]
    return out


def frame(spark, ids, matrix):
    return spark.createDataFrame([(i, [float(x) for x in v], 0, "b") for i, v in zip(ids, matrix)], "vec_id long, embedding array<float>, id int, block string")


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 1500)
    monkeypatch.setattr(neighbours, "CHUNK", 60)
    monkeypatch.setattr(neighbours, "LEAST_CANDIDATES", 64)
    random = np.random.default_rng(1)
    matrix = (random.normal(size=(4000, 48)) * random.uniform(0.5, 2, (4000, 1))).astype(np.float32).astype(float)
    ids = list(range(4000))
    found = neighbours.nearest(frame(spark, ids, matrix), F.col("id") % 50 == 0).collect()
    want = brute(ids, matrix, range(0, 4000, 50), 20)
    hits = 0
    for q, top in want.items():
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21))
        assert all(abs(r.score - matrix[r.vec_id] @ matrix[q]) < 1e-9 for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        hits += len({r.vec_id for r in mine} & {i for i, _ in top})
    assert hits >= 0.9 * 20 * len(want)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [3.0, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (20, [5.0, 5.0]), (9, []), (20, [6.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = sorted(map(tuple, neighbours.nearest(vectors, F.col("id") % 20 == 0).collect()))
    assert found == [
        (0, 1, 20, 15.0), (0, 2, 20, 6.0), (0, 3, 1, 5.0), (0, 4, 1, 5.0), (0, 5, 7, 5.0), (0, 6, 8, 1.0),
        (20, 1, 7, 20.0), (20, 2, 0, 15.0), (20, 3, 1, 15.0), (20, 4, 1, 15.0), (20, 5, 8, 5.0),
    ]
    assert neighbours.nearest(vectors.limit(0), F.col("id") % 20 == 0).count() == 0


def test_one_vector_for_a_third(spark):
    matrix = np.random.default_rng(2).normal(size=(900, 16)).astype(np.float32).astype(float)
    matrix[::3] = matrix[0]
    ids = list(range(900))
    found = neighbours.nearest(frame(spark, ids, matrix), F.col("id") == 300).collect()
    assert [r.vec_id for r in sorted(found, key=lambda r: r.rank)] == [i for i in range(0, 900, 3) if i != 300][:20]


@pytest.mark.parametrize("seed", range(3))
def test_agreement_is_footrule(seed):
    random = np.random.default_rng(seed)
    orders = np.array([random.permutation(12)[:5] for _ in range(40)])
    files = neighbours.InvertedFiles(orders, 12)
    query = random.permutation(12)[:5]
    place = lambda order: {p: i for i, p in enumerate(order.tolist())}
    mine = place(query)
    far = [sum(abs(i - place(o).get(p, 5)) for p, i in mine.items()) for o in orders]
    agreement = files.agreement(query)
    assert np.array_equal(agreement + np.array(far), np.full(40, sum(5 - i for i in range(5))))


@pytest.mark.parametrize("seed", range(5))
def test_equal_vectors_get_equal_scores(seed):
    """Whatever stands beside them and wherever they stand, for any width."""
    random = np.random.default_rng(seed)
    for width in (1, 2, 3, 7, 64, 100):
        one, query = random.normal(size=(2, width))
        rows = random.normal(size=(int(random.integers(5, 2000)), width))
        same = random.random(len(rows)) < 0.3
        same[:2] = True
        rows[same] = one
        scores = neighbours.inner_products(rows, query)
        assert len(set(scores[same].tolist())) == 1
        assert np.allclose(scores, rows @ query)


def test_recall_of_the_query_on_the_given_vectors(spark, folder):
    """Ids divisible by 50 against all rows, held against brute force."""
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids = [r.vec_id for r in rows]
    matrix = np.array([r.embedding for r in rows], float)
    asked = [i for i in ids if i % 50 == 0]
    found = neighbours.nearest(spark.read.parquet(f"{folder}/embeddings.parquet"), F.col("id") % 50 == 0).collect()
    want = brute(ids, matrix, asked, 20)
    hits = sum(len({r.vec_id for r in found if r.query_id == q} & {i for i, _ in top}) for q, top in want.items())
    assert hits >= 0.9 * 20 * len(asked)

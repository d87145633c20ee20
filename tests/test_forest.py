"""Forests whose trees are grown side by side."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.linalg import Vectors

from textvane.operators import forest, models


def rows_of(spark, n, width, seed, noise=0.3):
    """Sparse and dense vectors, some values negative; the label follows from two of them and chance."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        x = np.where(rng.random(width) < 0.3, np.round(rng.normal(0.4, 1.0, width), 2), 0.0)
        label = (x[0] > 0.2) + (x[1] > 0.1) if rng.random() > noise else rng.integers(0, 3)
        at = np.flatnonzero(x)
        out.append((i, Vectors.dense(x) if i % 7 == 0 else Vectors.sparse(width, at.tolist(), x[at].tolist()), float(label)))
    return spark.createDataFrame(out, ["doc_id", "features", "label_id"])


def test_forest_takes_few_jobs(spark):
    """A pass over the rows for each group of nodes would be a job for each group."""
    train = rows_of(spark, 300, 30, 1).persist()
    context = spark.sparkContext
    context.setJobGroup("few-jobs", "forest")
    try:
        model = models.fit("forest", train)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert model.totalNumNodes > 200 * 20
    assert len(context.statusTracker().getJobIdsForGroup("few-jobs")) <= 20


@pytest.mark.parametrize("n, depth", [(25, 3), (400, 6), (900, 5)])
def test_tree_is_that_of_the_library(spark, monkeypatch, n, depth):
    """One tree over all rows and features, each once; deeper trees have ties, which rounding decides."""

    class Once:
        def poisson(self, mean, size):
            return np.ones(size)

    train = rows_of(spark, n, 6, n).coalesce(1).persist()
    monkeypatch.setattr(forest, "_drawn", lambda rng, nodes, width, wanted: np.tile(np.arange(width), (nodes, 1)))
    vectors = train.selectExpr("features AS x", "label_id AS y")
    bins = min(32, n)
    thresholds = forest._thresholds(vectors, n, bins, 6, 1)
    chunks = vectors.mapInArrow(forest._binned(thresholds), "lengths binary, feature binary, bin binary, label binary").collect()
    kinds = (("lengths", "<i4"), ("feature", "<u2"), ("bin", "u1"), ("label", "<i4"))
    data = tuple(np.frombuffer(b"".join(c[k] for c in chunks), kind) for k, kind in kinds)
    grown = forest._merged(forest._Rows(data, thresholds, 3, bins).grow(Once(), depth))
    own = DecisionTreeClassifier(featuresCol="features", labelCol="label_id", maxDepth=depth).fit(train)
    assert grown["left"].size == own.numNodes
    cuts = forest._table(thresholds)

    def below(node):
        if grown["left"][node] < 0:
            return ("leaf", tuple(grown["stats"][node]))
        first = grown["left"][node]
        cut = cuts[grown["feature"][node], grown["cut"][node]]
        return (int(grown["feature"][node]), round(float(cut), 9), below(first), below(first + 1))

    def stored(node):
        if node.numDescendants() == 0:
            return ("leaf", tuple(node.impurityStats().stats()))
        return (node.split().featureIndex(), round(node.split().threshold(), 9), stored(node.leftChild()), stored(node.rightChild()))

    assert below(0) == stored(own._call_java("rootNode"))


def test_forest_votes_like_its_trees(spark):
    train, test = rows_of(spark, 600, 12, 3, noise=0.1).persist(), rows_of(spark, 300, 12, 4, noise=0.0).persist()
    model = models.fit("forest", train)
    scored = model.transform(test).collect()
    assert [r.pred_id for r in scored] == [model.predict(r.features) for r in scored]
    assert all(abs(sum(r.probability) - 1) < 1e-9 and abs(sum(r.rawPrediction) - 200) < 1e-6 for r in scored)
    assert all(r.rawPrediction.argmax() == r.pred_id for r in scored)
    library = models.classifier("forest", 600).fit(train).transform(test).collect()
    right = [sum(r.pred_id == r.label_id for r in found) for found in (scored, library)]
    assert right[0] > 0.8 * len(scored) and abs(right[0] - right[1]) < 0.05 * len(scored)


def test_trees_do_not_depend_on_steps_or_tasks(spark, monkeypatch):
    train = rows_of(spark, 300, 40, 5).persist()
    whole = models.fit("forest", train).trees
    monkeypatch.setattr(forest, "STEP_ELEMENTS", 500)
    monkeypatch.setattr(forest, "STEP_NODES", 3)
    monkeypatch.setattr(forest, "TREES_PER_TASK", 50)
    parts = models.fit("forest", train).trees
    assert all(np.array_equal(a, b) for a, b in zip(vars(whole).values(), vars(parts).values()))


def test_rows_that_do_not_fit_a_task_go_to_the_library(spark):
    train = rows_of(spark, 60, 5, 6).persist()
    estimator = RandomForestClassifier(featuresCol="features", labelCol="label_id", predictionCol="pred_id", numTrees=3, seed=1)
    assert len(forest.fit_forest(estimator, train, 60, limit=10).trees) == 3
    assert forest.fit_forest(estimator, train, 60).trees.roots.size == 3


def test_features_are_drawn_without_repeats():
    rng = np.random.default_rng(0)
    for width, wanted in ((10_000, 100), (7, 3), (4, 2), (1, 1)):
        drawn = forest._drawn(rng, 50, width, wanted)
        assert drawn.shape == (50, wanted) and all(len(set(x)) == wanted for x in drawn.tolist())
        assert drawn.min() >= 0 and drawn.max() < width

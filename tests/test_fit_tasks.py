"""How the baselines are run one after the other."""

from pyspark.sql import functions as F

from textvane.operators import models


def test_forest_is_fitted_last_and_garbage_goes(spark, monkeypatch):
    """The driver holds the forest's trees, so the models that start many jobs come before it."""
    names = ("negative", "neutral", "positive")
    rows = [(i, f"alpha {names[i % 3]} beta {i % 7} gamma", names[i % 3]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    split = df.withColumn("split", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train"))
    begun, real = [], models.fit
    monkeypatch.setattr(models, "fit", lambda name, train: begun.append(name) or real(name, train))
    monkeypatch.setattr(models, "released", lambda spark: begun.append("released"))
    found = models.run_baselines(split, ("logreg", "forest", "svm")).collect()
    assert begun == ["logreg", "released", "svm", "released", "forest", "released"]
    assert {r.model for r in found} == {"tfidf_logreg", "tfidf_forest", "tfidf_svm"}
    assert {r.value for r in found if r.metric == "support" and r["class"] is None} == {8.0}
    assert sum(r.metric == "training_time_seconds" for r in found) == 3


def test_a_small_training_set_is_one_task(spark):
    """A fit starts hundreds of jobs; a task for every few rows would need a shuffle in each."""
    assert models.ROWS_PER_FIT_TASK >= 16_478  # training rows of 0.1 GB

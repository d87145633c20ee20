"""Baseline text classifiers: TF-IDF features with three standard models."""

from __future__ import annotations

import math
import statistics
import time
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from textvane.config import LABEL_IDS, LATENCY_PROBE_ROWS, MAX_VOCABULARY
from textvane.functions.scores import decode_label, encode_label
from textvane.operators.evaluation import confusion_matrix, overall_metrics, per_class_metrics
from textvane.operators.features import idf, vocabulary, with_terms
from textvane.operators.forest import fit_forest
from textvane.session import checkpointed, released
from textvane.sources.sinks import results_table

# fixed values: settings of the three baselines
LOGREG_C, LOGREG_ITERATIONS = 1.0, 1000
FOREST_TREES, FOREST_SEED, FOREST_DEPTH = 200, 42, 30
SVM_C, SVM_ITERATIONS = 1.0, 2000
SVM_AT_ONCE = 3  # one-against-rest fits that run side by side (speed only)
TOLERANCE = 1e-4

# speed only
FOREST_MB = 128  # statistics of the nodes a task splits in one pass; each core of an executor holds as much

ROWS_PER_FIT_TASK = 20_000  # a pass over so many takes less time than to start its job; up to five tasks add up without a shuffle


class TfIdfModel:
    """Unit-length tf * (ln((n+1)/(df+1)) + 1) vectors over a fitted vocabulary."""

    def __init__(self, terms: list[str], weights: list[float], text: str):
        self.text = text
        counts = CountVectorizerModel.from_vocabulary(terms, inputCol="terms", outputCol="tf")
        scale = ElementwiseProduct(scalingVec=weights, inputCol="tf", outputCol="tfidf")
        unit = Normalizer(inputCol="tfidf", outputCol="features", p=2.0)
        self.stages = PipelineModel(stages=[counts, scale, unit])

    def transform(self, df: DataFrame) -> DataFrame:
        return self.stages.transform(with_terms(df, self.text)).drop("terms", "tf", "tfidf")


def fit_tfidf(df: DataFrame, text: str = "text", max_terms: int = MAX_VOCABULARY) -> TfIdfModel:
    """Vocabulary and idf weights from one aggregation; ``max_terms`` rows come to the driver."""
    n = df.count()
    terms = vocabulary(df, F.lit(n), max_terms, text=text)
    rows = terms.select("term", idf(F.col("df"), F.lit(float(n))).alias("w"), "cf").orderBy(F.col("cf").desc(), "term").collect()
    return TfIdfModel([r.term for r in rows], [r.w for r in rows], text)


def classifier(name: str, n_train: int):
    """The estimator of a baseline: logreg, forest or svm."""
    common = dict(featuresCol="features", labelCol="label_id", predictionCol="pred_id")
    if name == "logreg":
        return LogisticRegression(
            **common, regParam=1.0 / (LOGREG_C * n_train), standardization=False,
            maxIter=LOGREG_ITERATIONS, tol=TOLERANCE, family="multinomial",
        )
    if name == "forest":
        return RandomForestClassifier(
            **common, numTrees=FOREST_TREES, seed=FOREST_SEED, maxDepth=FOREST_DEPTH, featureSubsetStrategy="sqrt",
            maxMemoryInMB=FOREST_MB, cacheNodeIds=True,
        )
    if name == "svm":
        svm = LinearSVC(regParam=1.0 / (SVM_C * n_train), standardization=False, maxIter=SVM_ITERATIONS, tol=TOLERANCE)
        return OneVsRest(classifier=svm, parallelism=SVM_AT_ONCE, **common)
    raise ValueError(f"unknown baseline: {name}")


BASELINES = ("logreg", "forest", "svm")


def with_label_ids(df: DataFrame, ids: dict[str, int] = LABEL_IDS) -> DataFrame:
    return df.withColumn("label_id", encode_label(F.col("label"), ids).cast("double"))


def embedding_features(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Precomputed vectors as model features."""
    return df.withColumn("features", array_to_vector(F.col(column).cast("array<double>")))


def text_features(split: DataFrame, text: str = "text") -> DataFrame:
    """Features of a split corpus, fitted on its training part; kept for all models until ``unpersist``."""
    corpus = with_label_ids(split).persist()
    model = fit_tfidf(corpus.where("split = 'train'"), text)
    features = model.transform(corpus).select("doc_id", "label", "label_id", "split", "features").persist()
    features.count()
    corpus.unpersist()
    return features


def fit(name: str, train: DataFrame):
    """The fitted model of a baseline."""
    rows = max(train.count(), 1)
    if name == "forest":
        return fit_forest(classifier(name, rows), train, rows)
    # an iterative fit starts a job per pass, so a small training set goes into few tasks
    packed = train.coalesce(math.ceil(rows / ROWS_PER_FIT_TASK))
    return classifier(name, rows).fit(packed)


def fit_predict(name: str, train: DataFrame, test: DataFrame) -> DataFrame:
    """(id columns, label_id, pred_id) of the test rows; both frames carry ``features``."""
    return fit(name, train).transform(test)


def predictions_of(model, features: DataFrame, ids: dict[str, int] = LABEL_IDS) -> DataFrame:
    """(doc_id, true_label, pred_label) of the held-out rows."""
    return model.transform(features.where("split = 'test'")).select(
        "doc_id", F.col("label").alias("true_label"), decode_label(F.col("pred_id").cast("int"), ids).alias("pred_label")
    )


def baseline_predictions(name: str, features: DataFrame, ids: dict[str, int] = LABEL_IDS) -> DataFrame:
    """(doc_id, true_label, pred_label) of the held-out rows."""
    return predictions_of(fit(name, features.where("split = 'train'")), features, ids)


def evaluate_predictions(model: str, predictions: DataFrame) -> DataFrame:
    """Long result rows (model, metric, class, value) of one model."""
    matrix = checkpointed(confusion_matrix(predictions))  # a few rows, read again and again
    return results_table(model, overall_metrics(matrix), per_class_metrics(matrix))


def single_latencies(model, features: DataFrame, rows: int = LATENCY_PROBE_ROWS) -> list[float]:
    """Milliseconds of one prediction call for each of the first held-out rows, asked one by one."""
    first = features.where("split = 'test'").orderBy("doc_id").limit(rows).select("features").collect()
    ask = model.predict if hasattr(model, "predict") else lambda x: max(m.predictRaw(x)[1] for m in model.models)
    spent = []
    for row in first:
        start = time.perf_counter()
        ask(row.features)
        spent.append((time.perf_counter() - start) * 1000)
    return spent


def latency_metrics(spent: list[float]) -> dict[str, float]:
    """Mean, median, least, greatest and population deviation."""
    if not spent:
        return {}
    return {
        "latency_mean_ms": statistics.fmean(spent), "latency_median_ms": statistics.median(spent), "latency_min_ms": min(spent),
        "latency_max_ms": max(spent), "latency_std_ms": statistics.pstdev(spent),
    }


def run_baselines(split: DataFrame, names: tuple[str, ...] = BASELINES) -> DataFrame:
    """Fit, evaluate and time every baseline on one split: training time, latency of single predictions."""
    features = text_features(split)
    parts = {}
    for name in sorted(names, key=lambda x: x == "forest"):  # last, as the driver holds its trees; the others start many jobs
        start = time.perf_counter()
        model = fit(name, features.where("split = 'train'"))
        measured = {"training_time_seconds": time.perf_counter() - start, **latency_metrics(single_latencies(model, features))}
        spark = features.sparkSession
        rows = [(f"tfidf_{name}", metric, None, value) for metric, value in measured.items()]
        timing = spark.createDataFrame(rows, "model string, metric string, class string, value double")
        parts[name] = [evaluate_predictions(f"tfidf_{name}", checkpointed(predictions_of(model, features))), timing]
        del model  # with what the driver keeps of it and of its many jobs, before the next fit
        released(spark)
    features.unpersist()
    return reduce(lambda a, b: a.unionByName(b), [x for name in names for x in parts[name]])

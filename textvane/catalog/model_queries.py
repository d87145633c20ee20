"""Registered queries on models: features, baselines, scoring, evaluation."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from textvane.catalog.tables import (
    JUDGED, Catalog, corpus, documents, events, ev, judged_labels, r6, redact_steps_sql, table,
)
from textvane.catalog.corpus_queries import SPLIT_SQL, arithmetic_key
from textvane.catalog.log_queries import PATIENT, breaker_sql
from textvane.config import LABEL_IDS
from textvane.functions.scores import argmax_index, top_score
from textvane.operators import evaluation, features, models, recovery, scoring
from textvane.operators.monitor import linear_percentiles
from textvane.operators.sampling import train_test_split
from textvane.plans.evaluation import evaluate_held_out
from textvane.plans.serving import CIRCUIT_OPEN, as_events, refusals_as_events, score_requests
from textvane.session import checkpointed, scratch_path
from textvane.sources import sinks, training_log

CATALOG = Catalog()

# --- evaluation ---------------------------------------------------------------

MATRIX = """ls AS (SELECT DISTINCT l FROM (SELECT true_label AS l FROM {0} UNION ALL SELECT pred_label FROM {0})),
  cnt AS (SELECT true_label, pred_label, count(*) AS n FROM {0} GROUP BY ALL),
  cm AS (SELECT a.l AS true_label, b.l AS pred_label, coalesce(n, 0) AS n FROM ls a CROSS JOIN ls b
    LEFT JOIN cnt ON cnt.true_label = a.l AND cnt.pred_label = b.l),
  mg AS (SELECT l AS label, (SELECT sum(n) FROM cm WHERE true_label = l)::BIGINT AS support,
    (SELECT sum(n) FROM cm WHERE pred_label = l)::BIGINT AS predicted,
    (SELECT sum(n) FROM cm WHERE true_label = l AND pred_label = l)::BIGINT AS tp FROM ls),
  pc AS (SELECT label, CASE WHEN predicted = 0 THEN 0.0 ELSE tp::DOUBLE / predicted END AS precision,
    CASE WHEN support = 0 THEN 0.0 ELSE tp::DOUBLE / support END AS recall,
    CASE WHEN predicted + support = 0 THEN 0.0 ELSE 2.0::DOUBLE * tp / (predicted + support) END AS f1, support FROM mg),
  ov AS (SELECT (SELECT sum(n) FILTER (true_label = pred_label)::DOUBLE / sum(n) FROM cm) AS accuracy,
    avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1,
    sum(precision * support) / sum(support) AS weighted_precision, sum(recall * support) / sum(support) AS weighted_recall,
    sum(f1 * support) / sum(support) AS weighted_f1, sum(support)::BIGINT AS support FROM pc)"""
JUDGED_MATRIX = f"{JUDGED}, {MATRIX.format('judged')}"
OVERALL = ("accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_recall", "weighted_f1")


def matrix(spark, folder):
    return evaluation.confusion_matrix(judged_labels(spark, folder))


@CATALOG.add(f"WITH {JUDGED_MATRIX} SELECT true_label, pred_label, n FROM cm")
def confusion_matrix(spark, folder):
    return matrix(spark, folder)


@CATALOG.add(
    f"""WITH {JUDGED_MATRIX} SELECT true_label, CAST(sum(n) FILTER (pred_label = 'negative') AS BIGINT) AS negative,
  CAST(sum(n) FILTER (pred_label = 'neutral') AS BIGINT) AS neutral, CAST(sum(n) FILTER (pred_label = 'positive') AS BIGINT) AS positive
  FROM cm GROUP BY true_label"""
)
def confusion_table(spark, folder):
    return evaluation.confusion_table(matrix(spark, folder), sorted(LABEL_IDS))


@CATALOG.add(f"WITH {JUDGED_MATRIX} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM pc")
def per_class_metrics(spark, folder):
    metrics = evaluation.per_class_metrics(matrix(spark, folder))
    return metrics.select("label", r6("precision"), r6("recall"), r6("f1"), "support")


@CATALOG.add(f"WITH {JUDGED_MATRIX} SELECT {', '.join(f'round({c}, 6) AS {c}' for c in OVERALL)}, support FROM ov")
def overall_metrics(spark, folder):
    return evaluation.overall_metrics(matrix(spark, folder)).select(*[r6(c) for c in OVERALL], "support")


@CATALOG.add(
    f"""WITH {JUDGED_MATRIX}, rep AS (SELECT label, precision, recall, f1, support FROM pc
    UNION ALL SELECT 'accuracy', accuracy, accuracy, accuracy, support FROM ov
    UNION ALL SELECT 'macro avg', macro_precision, macro_recall, macro_f1, support FROM ov
    UNION ALL SELECT 'weighted avg', weighted_precision, weighted_recall, weighted_f1, support FROM ov)
  SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rep"""
)
def classification_report(spark, folder):
    report = evaluation.classification_report(matrix(spark, folder))
    return report.select("label", r6("precision"), r6("recall"), r6("f1"), "support")


@CATALOG.add(
    f"""WITH {JUDGED_MATRIX}, rep AS (SELECT label, precision, recall, f1, support FROM pc
    UNION ALL SELECT 'accuracy', accuracy, accuracy, accuracy, support FROM ov
    UNION ALL SELECT 'macro avg', macro_precision, macro_recall, macro_f1, support FROM ov
    UNION ALL SELECT 'weighted avg', weighted_precision, weighted_recall, weighted_f1, support FROM ov)
  SELECT unnest(['Classification Report - judged', repeat('=', 60), '']) AS value UNION ALL
  SELECT unnest(list_filter(['', CASE label WHEN 'macro avg' THEN 'Macro Average:' WHEN 'weighted avg' THEN 'Weighted Average:' ELSE 'Class: ' || label END,
    printf('  Precision: %.4f', precision), printf('  Recall:    %.4f', recall), printf('  F1-Score:  %.4f', f1),
    CASE WHEN label NOT IN ('macro avg', 'weighted avg') THEN printf('  Support:   %d', support) END], lambda x: x IS NOT NULL))
  FROM rep WHERE label <> 'accuracy'"""
)
def report_lines(spark, folder):
    """The report as written to and read back from a text file."""
    report = evaluation.classification_report(matrix(spark, folder))
    path = sinks.write_report(report, "judged", scratch_path(spark, "report"))
    return spark.read.text(path)


@CATALOG.add(
    f"""WITH {JUDGED_MATRIX}, res AS (SELECT unnest([{', '.join(f"'{c}'" for c in (*OVERALL, 'support'))}]) AS metric, NULL AS class,
    unnest([{', '.join(OVERALL)}, support]) AS value FROM ov
    UNION ALL SELECT unnest(['precision', 'recall', 'f1', 'support']), label, unnest([precision, recall, f1, support]) FROM pc)
  SELECT 'judged' AS model, metric, class, round(value, 6) AS value FROM res"""
)
def results_sink(spark, folder):
    """Long result rows, overall and per class, written as JSON and read back."""
    cells = matrix(spark, folder)
    rows = sinks.results_table("judged", evaluation.overall_metrics(cells), evaluation.per_class_metrics(cells))
    path = sinks.write_results(rows, scratch_path(spark, "results"))
    back = spark.read.schema("model string, metric string, class string, value double").json(path)
    return back.select("model", "metric", "class", r6("value"))


ALWAYS = re.sub(r"\b(ls|cnt|cm|mg|pc|ov)\b", r"\g<1>2", MATRIX.format("always"))  # the same steps under other names
SUMMARY_METRICS = ("accuracy", "macro_f1", "weighted_f1")


@CATALOG.add(
    f"""WITH {JUDGED_MATRIX}, always AS (SELECT true_label, 'neutral' AS pred_label FROM judged), {ALWAYS},
  two AS (SELECT 'judged' AS model, * FROM ov UNION ALL SELECT 'always_neutral', * FROM ov2)
  SELECT model, {', '.join(f'round({c}, 6) AS {c}' for c in SUMMARY_METRICS)} FROM two"""
)
def model_summary(spark, folder):
    rows = judged_labels(spark, folder)
    constant = rows.withColumn("pred_label", F.lit("neutral"))
    results = models.evaluate_predictions("judged", rows).unionByName(models.evaluate_predictions("always_neutral", constant))
    return sinks.model_summary(results, list(SUMMARY_METRICS)).select("model", *[r6(c) for c in SUMMARY_METRICS])


LOGITS = """lg AS (SELECT vec_id, label AS true_label, embedding AS e FROM embeddings),
  am AS (SELECT vec_id, true_label, list_position(e, list_max(e)) - 1 AS pred_label, list_max(e) AS top FROM lg)"""


def logits(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return vectors.select("vec_id", F.col("embedding").alias("logits"), F.col("label").alias("label_id"))


@CATALOG.add(
    f"""WITH {LOGITS} SELECT vec_id, CAST(pred_label AS INTEGER) AS pred_label, CAST(pred_label AS INTEGER) AS folded_label,
  round(top::DOUBLE, 6) AS score FROM am"""
)
def argmax_label(spark, folder):
    """The best class twice: by position, and by folding (label, score) structs."""
    scored = logits(spark, folder)
    pairs = F.transform("logits", lambda x, i: F.struct(i.alias("label"), x.cast("double").alias("score")))
    best = scored.select("vec_id", argmax_index(F.col("logits")).alias("pred_label"), top_score(pairs).alias("t"))
    return best.select("vec_id", "pred_label", F.col("t.label").alias("folded_label"), r6(F.col("t.score"), "score"))


@CATALOG.add(
    f"""WITH {LOGITS}, {MATRIX.format('am')} SELECT round(macro_f1, 6) AS f1_macro, round(accuracy, 6) AS accuracy,
  round(macro_precision, 6) AS precision_macro, round(macro_recall, 6) AS recall_macro FROM ov"""
)
def logit_metrics(spark, folder):
    metrics = evaluation.metrics_from_logits(logits(spark, folder))
    return metrics.select(*[r6(c) for c in metrics.columns])


@CATALOG.add(
    f"""WITH {ev()}, h AS (SELECT date_diff('day', DATE '2024-01-01', ts::DATE) AS step, round(avg(confidence), 6) AS f
    FROM ev GROUP BY 1) SELECT step, f AS eval_f1_macro FROM h WHERE step % 3 <> 0 ORDER BY f DESC, step LIMIT 1"""
)
def best_checkpoint(spark, folder):
    """A trainer's state file with one history row per day of the log; every third row has no F1."""
    step = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("step")
    daily = events(spark, folder).groupBy(step).agg(F.round(F.avg("confidence"), 6).alias("f"))
    row = F.struct("step", F.when(F.col("step") % 3 != 0, F.col("f")).alias("eval_f1_macro"))
    history = daily.agg(F.array_sort(F.collect_list(row)).alias("log_history"))  # one row per day
    path = sinks.write_metrics_json(history, scratch_path(spark, "trainer-state"))
    return training_log.best_checkpoint(training_log.load_history(spark, path)).select("step", "eval_f1_macro")


# --- features -----------------------------------------------------------------

WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}\p{Pc}]{2,}')"
TERMS = f"""wd AS (SELECT doc_id, {WORDS} AS w FROM documents),
  tm AS (SELECT doc_id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS term FROM wd),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM tm GROUP BY ALL),
  nd AS (SELECT count(*) AS n FROM documents),
  vc AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term
    HAVING count(*) >= 2 AND count(*) <= 0.95 * (SELECT n FROM nd) ORDER BY cf DESC, term LIMIT 10000)"""


@CATALOG.add(f"WITH {TERMS} SELECT term, df, cf FROM vc")
def tfidf_vocabulary(spark, folder):
    texts = documents(spark, folder)
    total = texts.agg(F.count(F.lit(1))).scalar()
    return features.vocabulary(texts, total)


@CATALOG.add(
    f"""WITH {TERMS}, w AS (SELECT doc_id, term, tf * (ln((n + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) + 1.0::DOUBLE) AS w FROM tf JOIN vc USING (term), nd)
  SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w"""
)
def tfidf_weights(spark, folder):
    return features.tfidf_weights(documents(spark, folder)).select("doc_id", "term", r6("weight"))


@CATALOG.add(
    f"""WITH wd AS (SELECT doc_id, {WORDS} AS w FROM documents),
  ids AS (SELECT term, row_number() OVER (ORDER BY cf DESC, term) + 1 AS id FROM (SELECT term, count(*) AS cf
    FROM (SELECT unnest(w) AS term FROM wd) GROUP BY term)),
  sq AS (SELECT doc_id, i, coalesce(id, 1) AS id FROM (SELECT doc_id, unnest(generate_series(1, least(len(w), 512))) AS i, w FROM wd)
    LEFT JOIN ids ON ids.term = w[i]),
  ag AS (SELECT doc_id, list(id ORDER BY i) AS s FROM sq GROUP BY doc_id),
  al AS (SELECT d.doc_id, coalesce(s, []) AS s FROM documents d LEFT JOIN ag USING (doc_id))
  SELECT doc_id, len(s) AS n_tokens, md5(array_to_string(list_concat(s, [0 FOR x IN range(512 - len(s))]), ',')) AS ids_md5 FROM al"""
)
def token_sequences(spark, folder):
    sequences = features.token_sequences(documents(spark, folder))
    used = F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x)
    ids = F.array_join(F.transform("input_ids", lambda x: x.cast("string")), ",")
    return sequences.select("doc_id", used.alias("n_tokens"), F.md5(ids).alias("ids_md5"))


# --- baselines ----------------------------------------------------------------


def baseline(name: str):
    def run(spark, folder):
        split = train_test_split(corpus(spark, folder), key=arithmetic_key())
        features = models.text_features(split)
        predictions = checkpointed(models.baseline_predictions(name, features))
        features.unpersist()
        return models.evaluate_predictions(f"tfidf_{name}", predictions)

    run.__name__ = f"baseline_{name}"
    return run


@CATALOG.add()
def baseline_results(spark, folder):
    """All baselines on one split: metrics of each, training time, latency of single predictions."""
    split = train_test_split(corpus(spark, folder), key=arithmetic_key())
    return models.run_baselines(split)


@CATALOG.add(
    f"""WITH {SPLIT_SQL}, t AS (SELECT label, count(*) AS support FROM split WHERE split = 'test' GROUP BY label)
  SELECT model, label, support, support AS n_predicted, true AS sums_agree FROM t, (SELECT unnest(['tfidf_logreg', 'tfidf_svm']) AS model)"""
)
def baseline_supports(spark, folder):
    """Held-out rows per class of the linear baselines, and the row sums of their confusion matrices.

    ``sums_agree``: precision and recall of the report follow from the matrix.
    """
    split = train_test_split(corpus(spark, folder), key=arithmetic_key())
    features = models.text_features(split)
    parts = []
    for name in ("logreg", "svm"):
        cells = evaluation.confusion_matrix(checkpointed(models.baseline_predictions(name, features)))
        sums = cells.groupBy(F.col("true_label").alias("label")).agg(
            F.sum("n").alias("n_predicted"), F.sum(F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0)).alias("hits")
        )
        report = evaluation.per_class_metrics(cells).where("support > 0").join(sums, "label")
        agree = F.abs(F.col("recall") * F.col("support") - F.col("hits")) < 1e-6
        parts.append(report.select(F.lit(f"tfidf_{name}").alias("model"), "label", "support", "n_predicted", agree.alias("sums_agree")))
    features.unpersist()
    return parts[0].unionByName(parts[1])


for _name in models.BASELINES:
    CATALOG.add()(baseline(_name))


@CATALOG.add()
def embedding_classifier(spark, folder):
    """The logistic baseline on precomputed vectors."""
    vectors = models.embedding_features(table(spark, folder, "embeddings"))
    labelled = vectors.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("class"), "features")
    split = train_test_split(labelled.withColumn("label", F.col("class").cast("string")))
    split = split.withColumn("label_id", F.col("class").cast("double")).persist()
    scored = models.fit_predict("logreg", split.where("split = 'train'"), split.where("split = 'test'"))
    named = scored.select(F.col("label").alias("true_label"), F.col("pred_id").cast("int").cast("string").alias("pred_label"))
    return models.evaluate_predictions("embedding_logreg", named)


# --- scoring ------------------------------------------------------------------

CLASSES = ("negative", "neutral", "positive")
TOO_LONG = 1500


def load_length_scorer():
    """A stand-in model: scores follow from the text's length, and very long texts make it fail."""

    def score(texts):
        if any(len(t) > TOO_LONG for t in texts):
            raise ValueError("sequence too long")
        out = []
        for t in texts:
            raw = [len(t) % m + 1 for m in (5, 7, 9)]
            out.append([{"label": c, "score": r / sum(raw)} for c, r in zip(CLASSES, raw)])
        return out

    return score


def scored_sql(source: str, text: str) -> str:
    return f"""raw AS (SELECT *, length({text}) AS l FROM {source}),
  pts AS (SELECT *, [l % 5 + 1, l % 7 + 1, l % 9 + 1] AS p FROM raw),
  best AS (SELECT *, list_max(p)::DOUBLE / list_sum(p) AS top,
    ['negative', 'neutral', 'positive'][list_position(p, list_max(p))] AS cls FROM pts)"""


@CATALOG.add(
    f"""WITH {scored_sql('documents', 'text')} SELECT doc_id, CASE WHEN l > {TOO_LONG} THEN 'error' ELSE cls END AS label,
  round(CASE WHEN l > {TOO_LONG} THEN 0.0 ELSE top END, 4) AS confidence, l <= {TOO_LONG} AND top >= 0.5::DOUBLE AS guardrails_passed,
  CASE WHEN l > {TOO_LONG} THEN 'INFERENCE_ERROR: sequence too long'
    WHEN top < 0.5::DOUBLE THEN printf('LOW_CONFIDENCE: %.3f < 0.5', top) ELSE '' END AS flags FROM best"""
)
def batch_scoring(spark, folder):
    scored = scoring.score_rows(documents(spark, folder).select("doc_id", "text"), load_length_scorer)
    answers = scoring.responses(scoring.verdicts(scored, 0.5), ["doc_id"])
    return answers.drop("pii_detected").withColumn("flags", F.array_join("flags", "; "))


def requests(spark, folder):
    threshold = F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") % 13 / 10.0)
    return documents(spark, folder).select(
        F.col("doc_id").alias("req_id"), "text", threshold.alias("confidence_threshold"), F.col("source").alias("key")
    )


THRESHOLD = "CASE WHEN doc_id % 7 = 0 THEN 0.7::DOUBLE ELSE (doc_id % 13)::DOUBLE / 10 END"
REQUEST_SQL = f"""{redact_steps_sql('documents')}, ok AS (SELECT red5.doc_id, r5, source AS key, {THRESHOLD.replace('doc_id', 'red5.doc_id')} AS t
    FROM red5 JOIN documents USING (doc_id) WHERE length(r0) BETWEEN 1 AND 2048), {scored_sql('ok', 'r5')},
  ans AS (SELECT *, l > {TOO_LONG} AS failed FROM best WHERE t BETWEEN 0 AND 1)"""


@CATALOG.add(
    f"""WITH {REQUEST_SQL}, asked AS (SELECT doc_id, length(text) AS n, {THRESHOLD} AS t FROM documents),
  bad AS (SELECT doc_id, [x FOR x IN [CASE WHEN n < 1 THEN 'text_too_short' END, CASE WHEN n > 2048 THEN 'text_too_long' END,
    CASE WHEN t < 0 OR t > 1 THEN 'threshold_out_of_range' END] IF x IS NOT NULL] AS why FROM asked)
  SELECT doc_id AS req_id, CASE WHEN failed THEN 'error' ELSE cls END AS label,
    round(CASE WHEN failed THEN 0.0 ELSE top END, 4) AS confidence, NOT failed AND top >= t AS passed, '' AS reasons FROM ans
  UNION ALL SELECT doc_id, NULL, NULL, NULL, array_to_string(why, ',') FROM bad WHERE len(why) > 0"""
)
def request_scoring(spark, folder):
    """Validate, redact, score, judge; rejected requests stay in the answer with their reasons."""
    judged, rejected = score_requests(requests(spark, folder), load_length_scorer)
    answers = judged.select("req_id", "label", F.round("confidence", 4).alias("confidence"), "passed", F.lit("").alias("reasons"))
    refused = rejected.select("req_id", F.array_join("reasons", ",").alias("reasons"))
    return answers.unionByName(refused, allowMissingColumns=True)


@CATALOG.add(
    f"""WITH {REQUEST_SQL} SELECT key, count(*) FILTER (NOT failed) AS request_count, count(*) FILTER (failed) AS error_count FROM ans GROUP BY key"""
)
def scored_request_log(spark, folder):
    """The request log that scoring leaves behind, summed per key."""
    from textvane.operators.monitor import error_rate

    judged, _ = score_requests(requests(spark, folder), load_length_scorer)
    return error_rate(as_events(judged), ["key"]).select("key", "request_count", "error_count")


# documents' sources as the keys of the log
SOURCE_KEY = "concat('src', user_id % 20)"


@CATALOG.add(
    f"""WITH RECURSIVE {ev(SOURCE_KEY)}, {breaker_sql()}, shut AS (SELECT key FROM walk WHERE rn > 0 GROUP BY key HAVING arg_max(sa, rn) = 'open'),
  asked AS (SELECT source AS key, source IN (SELECT key FROM shut) AS refused,
    length(text) BETWEEN 1 AND 2048 AND {THRESHOLD} BETWEEN 0 AND 1 AS good FROM documents)
  SELECT key, count(*) FILTER (NOT refused AND good) AS n_scored, count(*) FILTER (refused) AS n_refused,
    count(*) FILTER (NOT refused AND NOT good) AS n_invalid FROM asked GROUP BY key"""
)
def gated_scoring(spark, folder):
    """Requests against the breakers their key's log left behind: scored, refused, invalid."""
    replayed = recovery.circuit_breaker(events(spark, folder, SOURCE_KEY), PATIENT)
    states = recovery.circuit_states(replayed)
    judged, rejected = score_requests(requests(spark, folder), load_length_scorer, breakers=states)
    refused = refusals_as_events(rejected).select("key", F.lit("refused").alias("what"))
    scored = judged.select("key", F.lit("scored").alias("what"))
    invalid = rejected.where(~F.array_contains("reasons", CIRCUIT_OPEN)).select("key", F.lit("invalid").alias("what"))
    every = scored.unionByName(refused).unionByName(invalid)
    return every.groupBy("key").agg(*[F.count_if(F.col("what") == x).alias(f"n_{x}") for x in ("scored", "refused", "invalid")])


HELD_OUT = f"""{SPLIT_SQL}, src AS (SELECT d.doc_id, d.text, s.label FROM documents d JOIN split s USING (doc_id) WHERE s.split = 'test'),
  {scored_sql('src', 'text')},
  ev2 AS (SELECT label AS true_label, CASE WHEN l > {TOO_LONG} THEN 'error' ELSE cls END AS pred_label FROM best), {MATRIX.format('ev2')}"""


def held_out(spark, folder):
    return evaluate_held_out(train_test_split(corpus(spark, folder), key=arithmetic_key()), load_length_scorer)


@CATALOG.add(
    f"""WITH {HELD_OUT}, rep AS (SELECT label, precision, recall, f1, support FROM pc
    UNION ALL SELECT 'accuracy', accuracy, accuracy, accuracy, support FROM ov
    UNION ALL SELECT 'macro avg', macro_precision, macro_recall, macro_f1, support FROM ov
    UNION ALL SELECT 'weighted avg', weighted_precision, weighted_recall, weighted_f1, support FROM ov)
  SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rep"""
)
def held_out_evaluation(spark, folder):
    """The report on the test part of the corpus; a failed row is a class of its own."""
    return held_out(spark, folder).report.select("label", r6("precision"), r6("recall"), r6("f1"), "support")


@CATALOG.add(f"WITH {HELD_OUT} SELECT count(*) AS total_samples, true AS in_order FROM best")
def held_out_latency(spark, folder):
    """Samples of the test part, and whether their latency statistics are in order (the times themselves vary)."""
    latency = held_out(spark, folder).latency
    in_order = (F.col("mean") > 0) & (F.col("p50") > 0) & (F.col("p50") <= F.col("p95")) & (F.col("p95") <= F.col("p99"))
    return latency.select("total_samples", in_order.alias("in_order"))

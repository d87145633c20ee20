"""Batch scoring with a user-supplied model."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from textvane.config import CONFIDENCE_THRESHOLD
from textvane.functions.pii import with_redaction
from textvane.functions.scores import top_score
from textvane.operators.guardrails import confidence_flag, label_flag

SCORES = T.ArrayType(
    T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])
)
ERROR_LABEL = "error"
ERROR_PREFIX = "INFERENCE_ERROR: "

Scorer = Callable[[list[str]], list[list[dict]]]


def score_rows(df: DataFrame, load_scorer: Callable[[], Scorer], text: str = "text", timed: bool = False) -> DataFrame:
    """Add ``scores`` and ``score_error`` by running the model over Arrow batches.

    With ``timed`` every row is a call of its own, and ``latency_ms`` says how long it took.

    ``load_scorer`` is called once per task and returns a function from texts to score lists.
    A batch that fails is halved until the rows that fail stand alone, so one bad row costs
    itself and some repeated halves.
    """
    added = [T.StructField("scores", SCORES), T.StructField("score_error", T.StringType())]
    if timed:
        added.append(T.StructField("latency_ms", T.DoubleType()))
    out = T.StructType([*df.schema.fields, *added])

    def attempt(scorer: Scorer, texts: list[str]) -> tuple[list, list[str | None]]:
        try:
            return list(scorer(texts)), [None] * len(texts)
        except Exception as problem:
            if len(texts) == 1:
                return [None], [str(problem)]
        half = len(texts) // 2
        left, right = attempt(scorer, texts[:half]), attempt(scorer, texts[half:])
        return left[0] + right[0], left[1] + right[1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load_scorer()
        for frame in frames:
            result = frame.copy()
            if timed:
                scores, errors, spent = [], [], []
                for one in frame[text]:
                    start = time.perf_counter()
                    found, wrong = attempt(scorer, [one])
                    spent.append((time.perf_counter() - start) * 1000)
                    scores += found
                    errors += wrong
                result["latency_ms"] = spent
            else:
                scores, errors = attempt(scorer, list(frame[text])) if len(frame) else ([], [])
            result["scores"] = scores
            result["score_error"] = errors
            yield result

    return df.mapInPandas(run, out)


def verdicts(scored: DataFrame, threshold: Column | float = CONFIDENCE_THRESHOLD) -> DataFrame:
    """Top label, confidence, guardrail flags; a failed row is labelled ``error`` and fails."""
    top = scored.withColumn("_top", top_score(F.col("scores")))
    failed = F.col("score_error").isNotNull()
    named = top.select(
        "*",
        F.when(failed, F.lit(ERROR_LABEL)).otherwise(F.col("_top.label")).alias("label"),
        F.when(failed, F.lit(0.0)).otherwise(F.col("_top.score")).alias("confidence"),
    ).drop("_top")
    redacted = with_redaction(named) if "redacted_text" not in scored.columns else named
    checks = F.array_compact(F.array(confidence_flag(F.col("confidence"), threshold), label_flag(F.col("label"))))
    problem = F.array(F.concat(F.lit(ERROR_PREFIX), F.col("score_error")))
    flags = F.when(failed, problem).otherwise(checks)
    nothing = F.array().cast("array<string>")
    found = F.when(failed, nothing).otherwise(F.col("pii_detected"))
    return redacted.withColumn("flags", flags).withColumn("pii_detected", found).withColumn(
        "passed", F.size("flags") == 0
    )


def responses(judged: DataFrame, keep: Sequence[str] = ("req_id",)) -> DataFrame:
    """The response records: confidence to 4 decimals, latency to 2 when it was logged."""
    latency = [F.round("latency_ms", 2).alias("latency_ms")] if "latency_ms" in judged.columns else []
    return judged.select(
        *keep,
        "label",
        F.round("confidence", 4).alias("confidence"),
        F.col("passed").alias("guardrails_passed"),
        "flags",
        "pii_detected",
        *latency,
    )

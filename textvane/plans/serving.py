"""Scoring of a request table end to end, and the log it leaves behind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from textvane.functions.pii import with_redaction
from textvane.operators.scoring import ERROR_LABEL, score_rows, verdicts
from textvane.operators.validation import check_requests
from textvane.scale import join_on, lookup_side


CIRCUIT_OPEN = "circuit_open"


def gated(checked: DataFrame, breakers: DataFrame, key: str = "key") -> DataFrame:
    """Refuse the requests of a key whose breaker is open; ``breakers`` has (key, circuit_state)."""
    shut = breakers.where("circuit_state = 'open'").select(key, F.lit(True).alias("_shut")).dropDuplicates([key])
    joined = join_on(checked, lookup_side(shut), [key], "left")
    refused = F.coalesce("_shut", F.lit(False))
    return joined.select(
        *[c for c in checked.columns if c not in ("reasons", "valid")],
        F.when(refused, F.array(F.lit(CIRCUIT_OPEN))).otherwise(F.col("reasons")).alias("reasons"),
        (F.col("valid") & ~refused).alias("valid"),
    )


def score_requests(
    requests: DataFrame, load_scorer: Callable, redact_first: bool = True, breakers: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(judged predictions, rejected requests).

    With ``redact_first`` the model sees the redacted text only; either way the output
    carries just the redacted text.  With ``breakers`` an open breaker refuses its key's requests.
    """
    checked = check_requests(requests)
    if breakers is not None:
        checked = gated(checked, breakers)
    accepted = with_redaction(checked.where("valid").drop("reasons", "valid"))
    shown = "redacted_text" if redact_first else "text"
    scored = score_rows(accepted, load_scorer, shown)
    judged = verdicts(scored, F.col("confidence_threshold")).drop("text", "scores")
    return judged, checked.where("not valid").select(*requests.columns, "reasons")


def as_events(judged: DataFrame, key: str = "key") -> DataFrame:
    """Request-log rows of scored requests: errors on their own, successes with their label."""
    failed = F.col("label") == ERROR_LABEL
    return judged.select(
        F.col("req_id").alias("event_id"),
        F.col("ts") if "ts" in judged.columns else F.current_timestamp().alias("ts"),
        (F.col(key).cast("string") if key in judged.columns else F.lit("all")).alias("key"),
        F.when(failed, "error").otherwise("request").alias("kind"),
        (F.col("latency_ms") if "latency_ms" in judged.columns else F.lit(None).cast("double")).alias("latency_ms"),
        F.when(failed, "unknown").otherwise(F.col("label")).alias("label"),
        "confidence",
        failed.alias("error"),
    )


def refusals_as_events(rejected: DataFrame, key: str = "key") -> DataFrame:
    """Request-log rows of what an open breaker refused: each is an error on its own."""
    return rejected.where(F.array_contains("reasons", CIRCUIT_OPEN)).select(
        F.col("req_id").alias("event_id"),
        F.col("ts") if "ts" in rejected.columns else F.current_timestamp().alias("ts"),
        F.col(key).cast("string").alias("key"),
        F.lit("error").alias("kind"),
        F.lit(None).cast("double").alias("latency_ms"),
        F.lit("unknown").alias("label"),
        F.lit(0.0).alias("confidence"),
        F.lit(True).alias("error"),
    )

"""Label maps, argmax and small numeric expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from textvane.config import LABEL_IDS


def encode_label(label: Column, ids: dict[str, int] = LABEL_IDS) -> Column:
    """Class id of a label, -1 for a label outside the map."""
    pairs = [F.lit(x) for item in ids.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), label), F.lit(-1))


def decode_label(label_id: Column, ids: dict[str, int] = LABEL_IDS) -> Column:
    pairs = [F.lit(x) for name, i in ids.items() for x in (i, name)]
    return F.element_at(F.create_map(*pairs), label_id)


def argmax_index(values: Column) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def top_score(scores: Column) -> Column:
    """Element of an array of (label, score) with the highest score; the first one on ties."""
    return F.aggregate(
        F.slice(scores, 2, F.greatest(F.size(scores) - 1, F.lit(0))),
        F.element_at(scores, 1),
        lambda best, x: F.when(x["score"] > best["score"], x).otherwise(best),
    )


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def nearest_rank(ordered: Column, percent: float) -> Column:
    """``ordered[min(int(n*p/100), n-1)]`` of a sorted array, 0 when it is empty."""
    n = F.size(ordered)
    index = F.least((n * F.lit(float(percent)) / F.lit(100.0)).cast("int") + 1, n)
    return F.when(n > 0, F.get(ordered, index - 1)).otherwise(F.lit(0.0))


def sql_list(values: Iterable[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in sorted(values)) + "]"

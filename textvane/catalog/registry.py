"""All registered queries."""

from __future__ import annotations

from textvane.catalog import corpus_queries, log_queries, model_queries
from textvane.catalog.tables import Catalog


def catalog() -> Catalog:
    merged = Catalog()
    for part in (corpus_queries, log_queries, model_queries):
        twice = merged.keys() & part.CATALOG.keys()
        if twice:
            raise ValueError(f"registered twice: {sorted(twice)}")
        merged.update(part.CATALOG)
    return merged

"""All registered queries and their checks."""

from __future__ import annotations

from importlib import import_module

MODULES = ("text_queries", "corpus_queries", "metric_queries", "source_queries",
           "model_queries", "scoring_queries")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(getattr(import_module(f"inkprint.plans.{name}"), attribute))
    return dict(sorted(out.items()))


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("SQL")

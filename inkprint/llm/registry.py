"""Queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("op1_repeats", "op2_warc", "op3_repair", "op4_mixing", "op5_line_frequency",
           "op6_ngram_join", "op7_tiling", "op8_language", "op9_secrets", "op10_quality", "op11_bpe",
           "op12_turns", "op13_ranking")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(getattr(import_module(f"inkprint.llm.{name}"), attribute))
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("SQL")

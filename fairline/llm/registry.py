"""All registered queries of the subpackage: name -> (callable, checking SQL or None)."""

from __future__ import annotations

import importlib

_MODULES = ("queries_dedup", "queries_benchmark", "queries_text", "queries_web", "queries_vectors", "queries_audit")


def registered() -> dict:
    found: dict = {}
    for module in _MODULES:
        found.update(importlib.import_module(f"fairline.llm.{module}").QUERIES)
    return found

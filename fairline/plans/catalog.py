"""All registered queries: name -> (callable, checking SQL or None)."""

from __future__ import annotations

import importlib

_MODULES = ("catalog_feeds", "catalog_history", "catalog_identity", "catalog_markets", "catalog_streams", "catalog_runs", "catalog_stored")


def registered() -> dict:
    found: dict = {}
    for module in _MODULES:
        found.update(importlib.import_module(f"fairline.plans.{module}").QUERIES)
    return found

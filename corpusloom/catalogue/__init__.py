"""Named queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

import importlib

MODULES = ("words", "language", "pages", "search", "facets", "tables", "files")


def all_queries() -> dict:
    found = {}
    for name in MODULES:
        found.update(importlib.import_module(f"corpusloom.catalogue.{name}").QUERIES)
    return found


def all_oracles() -> dict:
    found = {}
    for name in MODULES:
        found.update(importlib.import_module(f"corpusloom.catalogue.{name}").ORACLES)
    return found

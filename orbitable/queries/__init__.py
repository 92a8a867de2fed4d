"""Registered queries: one Spark plan and, where SQL can state it, one DuckDB twin each."""

from __future__ import annotations

import importlib

from orbitable.queries.registry import ORACLES, QUERIES

_MODULES = ("molecules", "sterics", "modes", "tables", "selection", "models", "classes", "texts", "checks")


def load() -> None:
    for name in _MODULES:
        importlib.import_module(f"orbitable.queries.{name}")


__all__ = ["ORACLES", "QUERIES", "load"]

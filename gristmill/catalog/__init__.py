"""Registered queries, one module per kind of work."""

from __future__ import annotations

import importlib
from types import ModuleType

MODULES = ("curation", "quality", "validation", "outputs", "gates", "files", "streams", "runs")


def load() -> ModuleType:
    """The registry with all queries in it."""
    for name in MODULES:
        importlib.import_module(f"gristmill.catalog.{name}")
    return importlib.import_module("gristmill.catalog.registry")

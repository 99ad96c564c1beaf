"""Registered queries: name -> Spark query, oracle SQL and the operators it covers."""

from __future__ import annotations

import importlib

from .registry import REGISTRY, Registry

MODULES = ("tables", "aggregates", "series", "places", "rules", "files", "analyses")


def load() -> Registry:
    """Import every query module once and return the registry."""
    for module in MODULES:
        importlib.import_module(f"{__name__}.{module}")
    return REGISTRY

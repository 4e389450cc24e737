"""Named queries over the given tables, with their SQL counterparts."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("q_quality", "q_tree", "q_stats", "q_metrics", "q_models")


def load() -> tuple[dict, dict]:
    """``(queries, sql)`` after all query modules have registered."""
    for name in _MODULES:
        import_module(f"cpgspark.catalogue.{name}")
    registry = import_module("cpgspark.catalogue.registry")
    return registry.QUERIES, registry.SQL

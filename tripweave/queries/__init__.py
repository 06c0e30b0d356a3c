"""Operators bound to the benchmark tables, each with an SQL statement of its result where SQL can say it."""

from __future__ import annotations

from importlib import import_module

from tripweave.queries.registry import COVERS, ORACLES, QUERIES

FAMILIES = (
    "text_dates", "numeric_costs", "filters_joins", "summaries", "windows_topk",
    "reshaping", "flow", "geometry", "images", "surveys", "statistics", "files",
)


def load_all() -> None:
    """Import every family so the registry is complete."""
    for name in FAMILIES:
        import_module(f"tripweave.queries.{name}")


__all__ = ["COVERS", "ORACLES", "QUERIES", "load_all"]

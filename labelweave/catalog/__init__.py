"""Registered queries, each next to the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("documents", "labels", "quality", "cooccurrence", "evaluation", "comparison", "features", "routing", "sources", "hierarchy")


def load_catalog():
    """(queries, oracle SQL) of every family."""
    from labelweave.catalog import blocks  # noqa: F401
    from labelweave.catalog.registry import ORACLES, QUERIES

    for family in FAMILIES:
        import_module(f"labelweave.catalog.{family}")
    return QUERIES, ORACLES

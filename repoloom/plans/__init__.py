"""Named queries over the given tables, each with its SQL check."""

from __future__ import annotations

from importlib import import_module

MODULES = ["search_queries", "registry_queries", "symbol_queries", "reading_queries", "history_queries", "upkeep_queries"]


def _load() -> None:
    for module in MODULES:
        import_module(f"{__name__}.{module}")


def all_queries() -> dict:
    """Every registered query by name."""
    _load()
    from .catalog import QUERIES

    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    """SQL of the queries that have one."""
    _load()
    from .catalog import ORACLES

    return dict(ORACLES)

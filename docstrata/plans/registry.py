"""Names of the registered queries, what they run, and their SQL for DuckDB."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from docstrata.sources.views import with_views

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}
_MODULES = ("ingest", "search", "measures", "writing", "live", "further")


def query(name: str, sql: str | None = None, *views: str):
    """Register a function of (spark, sf_dir) under ``name``; ``sql`` may use the named views."""

    def register(f: Callable) -> Callable:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = with_views(sql, *views) if views else sql
        return f

    return register


def _load():
    for m in _MODULES:
        importlib.import_module(f"docstrata.plans.{m}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)

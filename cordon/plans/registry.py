"""All queries by name, with their DuckDB SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("quote_queries", "zone_queries", "series_queries", "model_queries", "source_queries")


def _all(what: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"cordon.plans.{m}"), what)()
    return out


def queries() -> dict:
    return _all("queries")


def oracle_sql() -> dict[str, str]:
    return _all("oracle_sql")

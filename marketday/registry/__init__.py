"""All registered queries and their oracle SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("views", "relational", "scalars", "marts", "governance", "io")


def _registries():
    return [import_module(f"{__name__}.{m}").R for m in MODULES]


def queries() -> dict:
    return {name: q for r in _registries() for name, q in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for r in _registries() for name, s in r.sql.items()}

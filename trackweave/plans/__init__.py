"""Registered queries by group, and the derived views that they read."""

from __future__ import annotations

from importlib import import_module

GROUPS = ("punctuality", "closures", "lines", "view", "resolution", "network", "records", "streams")


def queries() -> dict:
    return {name: q for group in GROUPS for name, q in import_module(f"{__name__}.{group}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for group in GROUPS for name, q in import_module(f"{__name__}.{group}").SQL.items()}

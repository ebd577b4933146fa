"""All core queries and their SQL, gathered from the modules that define them."""

from __future__ import annotations

import importlib

MODULES = ["scans", "relating", "ordering", "graphing", "strengthening", "knowing", "retrieving", "recalling", "ranking", "reading", "storing"]


def queries() -> dict:
    out: dict = {}
    for name in MODULES:
        out |= importlib.import_module(f"palimpsest.plans.{name}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out |= importlib.import_module(f"palimpsest.plans.{name}").ORACLE_SQL
    return out

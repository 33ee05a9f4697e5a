"""All queries over the driver's tables and their SQL, from the modules in `plans`."""

from __future__ import annotations

from importlib import import_module

MODULES = ("text_rules", "style", "corpus", "index", "tables", "workflow")


def _modules():
    return [import_module(f"scriptorium.plans.{m}") for m in MODULES]


def queries() -> dict:
    out = {}
    for m in _modules():
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for m in _modules():
        out |= m.ORACLE
    return out

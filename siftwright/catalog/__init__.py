"""Runnable queries by name."""

from importlib import import_module

_GROUPS = ["tables", "pairs", "packs", "checks", "reports"]


def _load():
    from siftwright.catalog import base

    for g in _GROUPS:
        import_module(f"siftwright.catalog.{g}")
    return base


def queries():
    return dict(_load().QUERIES)


def oracle_sql():
    return dict(_load().ORACLES)

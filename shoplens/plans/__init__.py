"""Named queries over the supplied tables, each next to the SQL that checks it."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "cleaning", "quality", "joins", "aggregates", "encoding", "ordering", "baskets", "similarity", "factors", "pairs",
    "models", "recommending", "fulltables", "clickstream", "streams", "store", "profiling", "monitoring",
)


def _load():
    for module in MODULES:
        import_module(f"shoplens.plans.{module}")
    return import_module("shoplens.plans.registry")


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)

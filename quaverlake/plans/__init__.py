"""Reports composed of operators, and the query registry."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("product_queries", "content_queries", "page_queries", "score_queries", "stream_queries")


def _load():
    for name in _MODULES:
        import_module(f"quaverlake.plans.{name}")
    from quaverlake.plans import registry
    return registry


def all_queries():
    return dict(_load().QUERIES)


def all_sql():
    return dict(_load().SQL)

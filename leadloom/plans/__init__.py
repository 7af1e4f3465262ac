"""Registered queries and the SQL each one is checked against."""

from importlib import import_module

_MODULES = ["register_queries", "key_queries", "queue_queries", "resolve_queries", "event_queries", "web_queries", "source_queries", "stream_queries"]


def _load():
    for module in _MODULES:
        import_module(f"leadloom.plans.{module}")
    from leadloom.plans import registry

    return registry


def queries():
    return dict(_load().QUERIES)


def oracle_sql():
    return dict(_load().ORACLES)

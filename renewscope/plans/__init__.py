"""End-to-end plans and the catalogue of named queries."""

from importlib import import_module

_QUERY_MODULES = ("study_queries", "audit_queries", "explore_queries", "score_queries", "shape_queries",
                  "model_queries", "stream_queries")


def load_catalog():
    """Import every query module once and return the catalogue."""
    for name in _QUERY_MODULES:
        import_module(f"renewscope.plans.{name}")
    return import_module("renewscope.plans.catalog")

"""End-to-end compositions and the registered queries with their SQL counterparts."""

from importlib import import_module

QUERY_MODULES = ("bar_queries", "panel_queries", "table_queries", "report_queries", "evaluation_queries", "model_queries")


def load_queries() -> None:
    """Import every module that registers queries."""
    for module in QUERY_MODULES:
        import_module(f"panelmill.plans.{module}")

"""Named queries: each reads the driver's tables (through the derived
fixtures) and runs the library's operators over all of their rows."""

from columbine.plans.registry import QUERIES, QuerySpec, register  # noqa: F401
from columbine.plans import delta_queries, graph_queries, text_queries, resolve_queries, rule_queries, dml_queries  # noqa: F401,E402


def all_queries():
    return dict(QUERIES)

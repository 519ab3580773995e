"""Registry of the log queries."""

from . import comparison_queries, effect_queries, history_queries, task_queries, value_queries  # noqa: F401
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)

"""Query handles and plan inspection."""

from quillon.plans.inspect import executed_plan, pushed_filters, read_columns, shuffles
from quillon.plans.query import QueryHandle, QueryState, submit

__all__ = ["QueryHandle", "QueryState", "executed_plan", "pushed_filters", "read_columns", "shuffles", "submit"]

"""quillon: a SQL and DataFrame analytics engine that leaves planning and execution to Spark."""

from quillon.catalog import Catalog
from quillon.errors import EngineError, ErrorCode
from quillon.plans.query import QueryHandle, QueryState, submit
from quillon.session import build_session

__all__ = ["Catalog", "EngineError", "ErrorCode", "QueryHandle", "QueryState", "build_session", "submit"]

"""Operators: functions from DataFrame to DataFrame that compose into one Catalyst plan."""

from quillon.operators.aggregate import AggSpec, aggregate, parse_specs
from quillon.operators.exchange import broadcast_small, gather, hash_exchange, round_robin
from quillon.operators.relational import anti_join, distinct, except_, intersect, join, limit, semi_join, top_k, union
from quillon.operators.scan import filter_rows, partition_filter, project, scan
from quillon.operators.windows import asof_join, first_last, lag_lead, ranked

__all__ = [
    "AggSpec", "aggregate", "anti_join", "asof_join", "broadcast_small", "distinct", "except_", "filter_rows", "first_last",
    "gather", "hash_exchange", "intersect", "join", "lag_lead", "limit", "parse_specs", "partition_filter",
    "project", "ranked", "round_robin", "scan", "semi_join", "top_k", "union",
]

"""Explicit data movement. Catalyst plans exchanges by itself; these are for layout that the caller wants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.errors import EngineError, ErrorCode
from quillon.operators.scan import require

#: The most bytes, by Catalyst's estimate, that broadcast_small() will hint and gather() will take.
BROADCAST_BYTES = 64 << 20
#: So many rows gather() takes whatever the estimate, which is unknown for rows made in the program.
GATHER_ROWS = 100_000


def hash_exchange(df: DataFrame, partitions: int, *keys: str) -> DataFrame:
    """Rows with equal keys meet in one of so many partitions."""
    if not keys:
        raise EngineError(ErrorCode.INVALID_ARGUMENT, "a hash exchange needs a key; see round_robin")
    require(df, *keys)
    return df.repartition(partitions, *keys)


def round_robin(df: DataFrame, partitions: int) -> DataFrame:
    return df.repartition(partitions)


def gather(df: DataFrame, limit: int = BROADCAST_BYTES, rows: int = GATHER_ROWS) -> DataFrame:
    """One partition, for small results only: more bytes than the limit, by estimate, and more rows than ``rows`` are refused."""
    if (size := estimated_bytes(df)) > limit and df.limit(rows + 1).count() > rows:
        raise EngineError(ErrorCode.INVALID_ARGUMENT, f"{size} bytes, by estimate, are too much for one partition; at most {limit}, or {rows} rows")
    return df.coalesce(1)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimised plan; from file sizes and statistics, without a job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint where the estimate stays under the limit, else df as it is: the join then shuffles."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df

"""Window helpers. All of them need a partition key, so that no window gathers all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from quillon.errors import EngineError, ErrorCode

RANKS = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}


def window(keys: list[str], order: list[str | Column]) -> WindowSpec:
    if not keys:
        raise EngineError(ErrorCode.INVALID_ARGUMENT, "a window needs a partition key")
    return Window.partitionBy(*keys).orderBy(*order)


def ranked(df: DataFrame, keys: list[str], order: list[str | Column], kind: str = "row_number", alias: str | None = None) -> DataFrame:
    """Adds a rank as bigint, under the kind's name unless an alias is given."""
    if kind not in RANKS:
        raise EngineError(ErrorCode.UNSUPPORTED, f"rank {kind!r}")
    return df.withColumn(alias or kind, RANKS[kind]().over(window(keys, order)).cast(T.LongType()))


def lag_lead(df: DataFrame, keys: list[str], order: list[str | Column], column: str, lag: str, lead: str, offset: int = 1) -> DataFrame:
    w = window(keys, order)
    return df.withColumns({lag: F.lag(column, offset).over(w), lead: F.lead(column, offset).over(w)})


def first_last(df: DataFrame, keys: list[str], order: list[str | Column], column: str, first: str, last: str) -> DataFrame:
    w = window(keys, order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({first: F.first(column).over(w), last: F.last(column).over(whole)})


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, take: list[str]) -> DataFrame:
    """Each left row with the columns ``take`` of the last right row of its keys whose ``time`` isn't after its own.

    Both sides are sorted once by keys and time, right rows first at equal times; a window carries the last right row
    on. One shuffle, no pairs. Of right rows with equal keys and time the one of the largest ``take`` values counts;
    left rows without one keep nulls.
    """
    one = left.select(*keys, F.col(time), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(F.struct(*take).alias("s")).schema["s"].dataType).alias("_right"))
    two = right.select(*keys, F.col(time), F.lit(None).cast(one.schema["_left"].dataType).alias("_left"), F.struct(*take).alias("_right"))
    # Rows in ROWS order: a left row follows all right rows of its time.
    order = Window.partitionBy(*keys).orderBy(time, F.col("_left").isNotNull(), "_right").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = one.union(two).withColumn("_last", F.last("_right", ignorenulls=True).over(order)).where(F.col("_left").isNotNull())
    return found.select("_left.*", *[F.col("_last").getField(c).alias(c) for c in take])

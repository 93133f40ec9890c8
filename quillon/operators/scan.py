"""Scan, filter, projection and the modulo partition filter."""

from __future__ import annotations

import operator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import EngineError, ErrorCode

COMPARISONS = {
    ">": operator.gt,
    "<": operator.lt,
    ">=": operator.ge,
    "<=": operator.le,
    "=": operator.eq,
    "<>": operator.ne,
}


def scan(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Parquet scan; columns not named are pruned, later filters are pushed into it."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def require(df: DataFrame, *names: str) -> None:
    for name in names:
        if name not in df.columns:
            raise EngineError(ErrorCode.SCHEMA, f"no column {name} in {df.columns}")


def filter_rows(df: DataFrame, column: str | Column, op: str | None = None, value: Any = None) -> DataFrame:
    """``filter_rows(df, "a", ">", 5)``, or any boolean Column alone. Rows for which it is NULL go."""
    if isinstance(column, Column):
        return df.where(column)
    require(df, column)
    if op not in COMPARISONS:
        raise EngineError(ErrorCode.UNSUPPORTED, f"comparison {op!r}; known: {', '.join(COMPARISONS)}")
    return df.where(COMPARISONS[op](F.col(column), F.lit(value)))


def project(df: DataFrame, *columns: str | Column) -> DataFrame:
    """Subset, reorder, repeat, rename or compute columns."""
    require(df, *(c for c in columns if isinstance(c, str) and c != "*"))
    return df.select(*columns)


def partition_filter(df: DataFrame, column: str, partition: int, partitions: int) -> DataFrame:
    """Rows with ``column % partitions == partition``; the sign follows the dividend. NULL keys go."""
    require(df, column)
    if partitions <= 0 or not 0 <= partition < partitions:
        raise EngineError(ErrorCode.INVALID_ARGUMENT, f"partition {partition} of {partitions}")
    if not isinstance(df.schema[column].dataType, T.IntegralType):
        raise EngineError(ErrorCode.SCHEMA, f"{column} isn't an integer")
    return df.where(F.col(column) % F.lit(partitions) == F.lit(partition))


def parse_partition(text: str) -> tuple[int, int]:
    """``"1|4"``: partition 1 of 4."""
    parts = text.split("|")
    if len(parts) != 2 or not all(p.strip().isdigit() for p in parts):
        raise EngineError(ErrorCode.INVALID_ARGUMENT, f"partition spec {text!r}")
    return int(parts[0]), int(parts[1])

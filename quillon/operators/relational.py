"""Joins, set operations, ordering and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from quillon.errors import EngineError, ErrorCode
from quillon.operators.exchange import broadcast_small

KINDS = {"inner", "left", "right", "full"}


def join(left: DataFrame, right: DataFrame, on: str | list[str] | Column, kind: str = "inner") -> DataFrame:
    """Catalyst picks the algorithm; a right side of a small estimated size gets a broadcast hint."""
    if kind not in KINDS:
        raise EngineError(ErrorCode.UNSUPPORTED, f"join kind {kind!r}; known: {', '.join(sorted(KINDS))}")
    return left.join(broadcast_small(right) if kind in ("inner", "left") else right, on, kind)


def semi_join(left: DataFrame, right: DataFrame, on: str | list[str] | Column) -> DataFrame:
    return left.join(right, on, "left_semi")


def anti_join(left: DataFrame, right: DataFrame, on: str | list[str] | Column) -> DataFrame:
    return left.join(right, on, "left_anti")


def union(left: DataFrame, right: DataFrame, all_rows: bool = False) -> DataFrame:
    both = left.union(right)
    return both if all_rows else both.distinct()


def intersect(left: DataFrame, right: DataFrame, all_rows: bool = False) -> DataFrame:
    return left.intersectAll(right) if all_rows else left.intersect(right)


def except_(left: DataFrame, right: DataFrame, all_rows: bool = False) -> DataFrame:
    return left.exceptAll(right) if all_rows else left.subtract(right)


def distinct(df: DataFrame, *columns: str) -> DataFrame:
    return (df.select(*columns) if columns else df).distinct()


def top_k(df: DataFrame, k: int, *order: str | Column) -> DataFrame:
    """The first k rows by an order: each partition keeps k rows, so no global sort takes place."""
    return df.orderBy(*order).limit(k)


def limit(df: DataFrame, k: int, offset: int = 0, order: list[str | Column] | None = None) -> DataFrame:
    df = df.orderBy(*order) if order else df
    return df.offset(offset).limit(k) if offset else df.limit(k)

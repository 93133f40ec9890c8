"""What Catalyst made of a plan, as text, for tests and tuning."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def executed_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[([^\]]*)\]", executed_plan(df))


def read_columns(df: DataFrame) -> list[list[str]]:
    """The columns that each scan reads."""
    return [re.findall(r"(\w+):", m) for m in re.findall(r"ReadSchema: struct<([^>]*)>", executed_plan(df))]


def shuffles(df: DataFrame) -> int:
    return len(re.findall(r"\bExchange ", executed_plan(df)))

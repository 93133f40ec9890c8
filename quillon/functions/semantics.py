"""Opt-in variants where other engines treat NULL, NaN and float equality in another way than Spark's defaults."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F


def sum_or_zero(column: str) -> Column:
    """SUM that is 0, not NULL, for a group with NULLs only."""
    return F.coalesce(F.sum(column), F.lit(0))


def float_equals(column: str, value: float) -> Column:
    """Equality within one machine epsilon."""
    return F.abs(F.col(column) - F.lit(value)) < F.lit(sys.float_info.epsilon)


def never_nan(column: str, predicate: Column) -> Column:
    """A predicate that no NaN passes."""
    return ~F.isnan(column) & predicate


def max_ignoring_nan(column: str) -> Column:
    """MAX over the values that aren't NaN."""
    return F.max(F.when(~F.isnan(column), F.col(column)))

"""Registration of pure functions for SQL. They run on Arrow batches, never row by row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def register_pure(spark: SparkSession, name: str, kind: str, function: Callable) -> Callable:
    """Registers a function of pandas Series under a name; equal arguments must give equal results."""
    udf = F.pandas_udf(function, kind)
    spark.udf.register(name, udf)
    return udf

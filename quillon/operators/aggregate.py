"""Grouped and global aggregation by specifications, with the engine's default output names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import EngineError, ErrorCode
from quillon.operators.scan import require

ORDERED = (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class AggSpec:
    """One aggregate. Without an alias: ``count`` for COUNT(*), else ``func_column``."""

    func: str
    column: str | None = None
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or (self.func if self.column is None else f"{self.func}_{self.column}")

    def check(self, df: DataFrame) -> None:
        if self.func not in FUNCTIONS:
            raise EngineError(ErrorCode.UNSUPPORTED, f"aggregate {self.func!r}; known: {', '.join(FUNCTIONS)}")
        if self.column is None:
            if self.func != "count":
                raise EngineError(ErrorCode.INVALID_ARGUMENT, f"{self.func} needs a column")
            return
        require(df, self.column)
        kind = df.schema[self.column].dataType
        if self.func in ("sum", "avg") and not isinstance(kind, T.NumericType):
            raise EngineError(ErrorCode.SCHEMA, f"{self.func}({self.column}): {kind.simpleString()} isn't numeric")
        if self.func in ("min", "max") and not isinstance(kind, ORDERED):
            raise EngineError(ErrorCode.SCHEMA, f"{self.func}({self.column}): {kind.simpleString()} has no order")

    def expression(self) -> Column:
        return FUNCTIONS[self.func](F.lit(1) if self.column is None else F.col(self.column)).alias(self.name)


FUNCTIONS = {
    "count": F.count,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "avg": F.avg,
    "count_distinct": F.count_distinct,
    "array_agg": F.collect_list,
    "median": F.median,
    "approx_median": lambda c: F.percentile_approx(c, 0.5),
}


def parse_specs(text: str) -> list[AggSpec]:
    """``"count();sum:amount"``: specifications as text, separated by semicolons; blanks around them don't count."""
    specs = []
    for part in filter(None, (p.strip() for p in text.split(";"))):
        func, _, column = (x.strip() for x in part.partition(":"))
        func = func.lower().removesuffix("()")
        if func not in FUNCTIONS or (not column and func != "count"):
            raise EngineError(ErrorCode.INVALID_ARGUMENT, f"aggregate spec {part!r}")
        specs.append(AggSpec(func, column or None))
    return specs


def aggregate(df: DataFrame, keys: list[str] | tuple[str, ...] = (), specs: list[AggSpec] | tuple[AggSpec, ...] = ()) -> DataFrame:
    """Aggregates by keys; without keys over all rows; without specifications the distinct keys.

    Spark aggregates each input partition before the exchange on the keys, so that a hot key moves as one row
    per task.
    """
    require(df, *keys)
    if not keys and not specs:
        raise EngineError(ErrorCode.INVALID_ARGUMENT, "neither keys nor aggregates")
    for spec in specs:
        spec.check(df)
    if not specs:
        return df.select(*keys).distinct()
    columns = [s.expression() for s in specs]
    return df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)

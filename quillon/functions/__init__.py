"""Column functions."""

from quillon.functions.semantics import float_equals, max_ignoring_nan, never_nan, sum_or_zero
from quillon.functions.udf import register_pure

__all__ = ["float_equals", "max_ignoring_nan", "never_nan", "register_pure", "sum_or_zero"]

"""Ratios and percentages.

``integer_ratio=True`` reproduces integer/integer division (truncation toward
zero), the behaviour of the original metric definitions; the default is the
corrected fractional ratio.  Division by zero yields NULL instead of failing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(num: Column, den: Column) -> Column:
    """``num / den`` as double; NULL on a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def int_div(num: Column, den: Column) -> Column:
    """Exact truncating division of two integers; NULL on a zero denominator."""
    num, den = num.cast("long"), den.cast("long")
    return F.call_function("div", num, F.nullif(den, F.lit(0).cast("long")))


def percent(num: Column, den: Column, integer_ratio: bool = False) -> Column:
    """``num / den * 100`` as double."""
    if integer_ratio:
        return (int_div(num, den) * 100).cast("double")
    return safe_div(num, den) * 100.0

"""Day truncation and time differences on ``timestamp_ntz`` columns.

``date_trunc`` returns a zoned timestamp in Spark, so day-level comparisons use
``to_date`` (zone-free) and day arithmetic uses exact microsecond differences.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def day(col) -> Column:
    """Calendar day of a timestamp, for day-level comparisons."""
    return F.to_date(col)


def midnight(col) -> Column:
    """``date_trunc('day', ts)`` kept as ``timestamp_ntz``."""
    return F.to_date(col).cast("timestamp_ntz")


def micros_between(start, end) -> Column:
    """``end - start`` in whole microseconds (NULL if either side is NULL)."""
    return F.timestamp_diff("MICROSECOND", start, end)


def days_between(start, end, digits: int | None = None) -> Column:
    """``end - start`` in fractional days (``EXTRACT(EPOCH FROM end - start) / 86400``).

    ``digits`` rounds the result, e.g. 6 for an interval that was divided and
    therefore rounded to whole microseconds of a day.
    """
    out = micros_between(start, end) / F.lit(float(MICROS_PER_DAY))
    return F.round(out, digits) if digits is not None else out


def ts_literal(value) -> Column:
    """A ``timestamp_ntz`` literal from a date, datetime or ISO text."""
    if isinstance(value, _dt.datetime):
        text = value.strftime("%Y-%m-%d %H:%M:%S")
    elif isinstance(value, _dt.date):
        text = value.strftime("%Y-%m-%d 00:00:00")
    else:
        text = str(value)
    return F.lit(text).cast("timestamp_ntz")

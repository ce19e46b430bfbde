"""Column expressions shared by the jobs (all built-in, JVM-side functions)."""

from dxlens.functions.keys import composite_key
from dxlens.functions.labels import first_label
from dxlens.functions.ratios import int_div, percent, safe_div
from dxlens.functions.temporal import day, days_between, midnight, micros_between, ts_literal

__all__ = ["composite_key", "first_label", "percent", "safe_div", "int_div", "day", "days_between",
           "midnight", "micros_between", "ts_literal"]

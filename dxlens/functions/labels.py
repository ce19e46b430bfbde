"""Ordered label assignment where a later rule overrides an earlier one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_label(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """``CASE`` over ``rules`` in the given order; the first true rule wins.

    A sequence of overwriting updates (the last matching one wins) becomes
    one expression by passing its rules in reverse order.
    """
    out = None
    for cond, label in rules:
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))

"""Two-sided matching of keyed rows and per-group match statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def full_match(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]],
               left_alias: str = "l", right_alias: str = "r") -> DataFrame:
    """Full outer join on column pairs; NULL keys stay unmatched on both sides.

    Callers reduce both sides to their distinct projections first, so each
    key's many-to-many product is formed from distinct rows only.
    """
    l, r = left.alias(left_alias), right.alias(right_alias)
    cond = None
    for a, b in on:
        c = F.col(f"{left_alias}.{a}") == F.col(f"{right_alias}.{b}")
        cond = c if cond is None else cond & c
    return l.join(r, cond, "full")


def match_stats(df: DataFrame, keys: Sequence[str], counts: Mapping[str, Column],
                dtype: str = "double") -> DataFrame:
    """Per group of ``keys``: the number of rows meeting each condition (or, of a numeric column, its sum)."""
    aggs = [F.sum(cond.cast("long")).cast(dtype).alias(name) for name, cond in counts.items()]
    return df.groupBy(*keys).agg(*aggs)

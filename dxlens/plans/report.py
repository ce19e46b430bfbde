"""Reconciliation of distinct discharges across the stages."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconciliation(stages: Mapping[str, DataFrame], key: str = "dischid") -> DataFrame:
    """One row per stage: ``(stage, discharges)`` = distinct non-NULL ``key`` values.

    The keys of all stages go through one grouping: a key becomes one row with the set of its stages as
    bits, pre-aggregated map-side, and one more aggregate counts the bits.  So the stages, of which
    only the key column is read, share one shuffle.  At most 63 stages; an empty stage counts 0.
    """
    if not 0 < len(stages) <= 63:
        raise ValueError("1 to 63 stages")
    bits = {name: F.lit(1 << i).cast("long") for i, name in enumerate(stages)}
    marked = reduce(DataFrame.unionByName, [
        df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), bits[name].alias("_stages"))
        for name, df in stages.items()])
    keys = marked.groupBy("_key").agg(F.bit_or("_stages").alias("_stages"))
    counts = keys.agg(*[F.count_if(F.col("_stages").bitwiseAND(bit) != 0).alias(f"_{i}") for i, bit in enumerate(bits.values())])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("stage"), F.col(f"_{i}").alias("discharges")) for i, name in enumerate(bits)])))

"""Exact median of groups of any size.

``F.median`` keeps all different values of a group in one buffer.  Here equal values
are counted first (partial aggregates), the counted values are range-partitioned by
(group, value) and stored, and running totals say which row holds a group's middle
ranks: the totals of earlier partitions, one row per (group, partition), plus a
window inside the partition.  No task sees more than one partition of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dxlens.sources.sinks import materialise


def exact_median(df: DataFrame, by: Sequence[str], value: str, out: str = "median", how: str = "table") -> DataFrame:
    """``by`` and ``out``: the median of the non-NULL ``value``s of each group, as a double; NULL where there is none.

    Even counts take the mean of the two middle values.  NULL keys form groups as in ``groupBy``; with no ``by``
    there is one row, also for an empty ``df``.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    named = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(value).cast("double").alias("_v"))
    counted = named.where(F.col("_v").isNotNull()).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    dealt = materialise(counted.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()), how, "median")

    parts = dealt.groupBy(*keys, "_part").agg(F.sum("_n").alias("_held"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    parts = parts.select(*keys, "_part", F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_start"),
                         F.sum("_held").over(whole).alias("_total"))
    inside = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("_upto", F.sum("_n").over(inside))
    placed = placed.join(parts.select(*[F.col(k).alias(f"{k}r") for k in keys], F.col("_part").alias("_partr"), "_start", "_total"),
                         _same(keys) & (F.col("_part") == F.col("_partr")))
    last = F.col("_start") + F.col("_upto")

    def at(rank: Column) -> Column:
        return F.max(F.when((rank > last - F.col("_n")) & (rank <= last), F.col("_v")))

    low, high = F.expr("(_total + 1) div 2"), F.expr("_total div 2 + 1")
    middle = placed.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias(out))
    if not by:
        return middle
    groups = named.select(*keys).distinct()
    met = groups.join(middle.select(*[F.col(k).alias(f"{k}r") for k in keys], out), _same(keys), "left")
    return met.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], out)


def _same(keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{k}r"))
    return cond

"""Equi joins with a range residual, split on hot keys.

The snapshot and stay jobs join edits to discharges of the same patient and
keep pairs that satisfy day-level range conditions.  The equi key (patient) is
the only hashable part, so one patient with a large share of all rows would put
all of its pairs into one task.

:func:`hot_key_join` splits such keys on a grid.  A key costs rows x rows, so
per key it counts the rows of both sides (map-side pre-aggregated counts); a key
of more than ``task_pairs`` pairs gets ``a`` buckets for the large side and ``b``
for the small side, ``a * b`` cells of about ``task_pairs`` pairs each, as near
to square as the sides allow.  A large-side row goes to
bucket ``hash(row id) % a`` and is copied to every small bucket; a small-side
row goes to ``hash(row id) % b`` and is copied to every large bucket; the join
then runs on (key, large bucket, small bucket), so every pair meets in exactly
one task.  When the small side is never split (no row id) this
is plain salting (``b = 1``).  Buckets come from hashes, not random numbers, so
a partition recomputed after an executor loss lands in the same buckets.  Cold
keys keep bucket (0, 0) and join as usual.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_TASK_PAIRS = 50_000_000


def hot_keys(big: DataFrame, keys: Sequence[str], task_pairs: int, small: DataFrame,
             split_small: bool = True) -> DataFrame:
    """Keys of more than ``task_pairs`` pairs: ``_buckets`` (large side) and ``_spread`` (small side).

    Such a key has at least ``2 * sqrt(task_pairs)`` rows, so the table is small against
    its inputs; how it is joined is left to the planner, which knows its size.
    """
    def counted(df, name):
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))

    hot = counted(big, "_nb").join(counted(small, "_ns"), list(keys)).where(
        F.col("_nb").cast("double") * F.col("_ns") > task_pairs)
    cells = F.ceil(F.col("_nb").cast("double") * F.col("_ns") / task_pairs)
    if split_small:
        a = F.least(F.col("_nb"), F.greatest(F.lit(1), F.ceil(F.sqrt(cells * F.col("_nb") / F.col("_ns")))))
        b = F.greatest(F.lit(1), F.least(F.col("_ns"), F.ceil(cells / a)))
    else:
        a, b = F.least(F.col("_nb"), cells), F.lit(1)
    return hot.select(*keys, a.cast("int").alias("_buckets"), b.cast("int").alias("_spread"))


def hot_key_join(big: DataFrame, small: DataFrame, keys: Sequence[str], residual: Column | None = None,
                 *, row_id: Sequence[str], small_row_id: Sequence[str] | None = None,
                 task_pairs: int = DEFAULT_TASK_PAIRS,
                 big_alias: str = "b", small_alias: str = "s", hot: DataFrame | None = None,
                 partitions: int | None = None) -> DataFrame:
    """Inner join ``big`` and ``small`` on ``keys`` and ``residual``.

    ``residual`` may refer to both sides through ``big_alias`` and
    ``small_alias``; the result carries both sides' columns under those
    aliases.  ``row_id`` / ``small_row_id`` name columns whose hash spreads a
    hot key's rows over its buckets (without ``small_row_id`` the small side
    is only replicated, never split).  ``hot`` is a precomputed
    :func:`hot_keys` table (e.g. shared by several joins of the same inputs);
    by default it is computed from both sides.  ``partitions``: both sides are dealt into so many.
    """
    if hot is None:
        hot = hot_keys(big, keys, task_pairs, small, bool(small_row_id))
    a = F.coalesce(F.col("_buckets"), F.lit(1))
    b = F.coalesce(F.col("_spread"), F.lit(1)) if small_row_id else F.lit(1)

    def bucket(cols, n):
        return F.when(n > 1, F.pmod(F.xxhash64(*[F.col(c) for c in cols]), n)).otherwise(0).cast("int")

    big_s = (big.join(hot, list(keys), "left")
             .withColumn("_sa", bucket(row_id, a))
             .withColumn("_sb", F.explode(F.sequence(F.lit(0), b - 1)))
             .drop("_buckets", "_spread"))
    small_s = (small.join(hot, list(keys), "left")
               .withColumn("_sb", bucket(small_row_id, b) if small_row_id else F.lit(0))
               .withColumn("_sa", F.explode(F.sequence(F.lit(0), a - 1)))
               .drop("_buckets", "_spread"))
    if partitions:
        big_s, small_s = (df.repartition(partitions, *keys, "_sa", "_sb") for df in (big_s, small_s))
    cond = ((F.col(f"{big_alias}._sa") == F.col(f"{small_alias}._sa"))
            & (F.col(f"{big_alias}._sb") == F.col(f"{small_alias}._sb")))
    for k in keys:
        cond = cond & (F.col(f"{big_alias}.{k}") == F.col(f"{small_alias}.{k}"))
    if residual is not None:
        cond = cond & residual
    return big_s.alias(big_alias).join(small_s.alias(small_alias), cond, "inner")

"""Group-wise selection and flagging.

Each operator reduces a group to one small row with an aggregate (which Spark
pre-aggregates map-side, so a hot group never lands whole in one task) and
joins that row back on the group key.  NULL keys never match, exactly like the
``=`` join conditions these operators replace.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dxlens.functions.keys import all_present


def latest_per_group(df: DataFrame, keys: Sequence[str], order: str, keep_ties: bool = True) -> DataFrame:
    """Rows whose ``order`` value is the greatest of their group.

    Ties on the greatest value are all kept (``keep_ties``) as a strict
    "no later row exists" test keeps them; ``keep_ties=False`` keeps one row per
    group, the one with the smallest remaining columns.  Groups are versions of
    one entity and small, so a ranked window is used: Catalyst adds a
    group-limit below the window.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    if keep_ties:
        return df.where(F.col(order).isNotNull()).withColumn("_r", F.rank().over(w)).where("_r = 1").drop("_r")
    others = [c for c in df.columns if c not in keys and c != order]
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc(), *[F.col(c).asc_nulls_last() for c in others])
    return df.where(F.col(order).isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def argmin_then_max(df: DataFrame, keys: Sequence[str], minimise: str, tiebreak: str) -> DataFrame:
    """Per group: smallest ``minimise``; among those rows the largest ``tiebreak``.

    Keeps *every* row of the group whose ``tiebreak`` equals that winner,
    whatever its own ``minimise`` value (the semantics of joining back on
    the key and the winning ``tiebreak``).  Rows with a NULL key are dropped.
    One partial aggregate of ``min(struct(minimise, -tiebreak))`` finds the
    winner; the join back is on the group key plus ``tiebreak``, which spreads
    even a hot group over many partitions.
    """
    present = df.where(all_present(*keys))
    cand = F.when(F.col(minimise).isNotNull() & F.col(tiebreak).isNotNull(),
                  F.struct(F.col(minimise).alias("m"), (-F.col(tiebreak)).alias("t")))
    best = (present.groupBy(*keys).agg(F.min(cand).alias("_best"))
            .where(F.col("_best").isNotNull())
            .select(*keys, (-F.col("_best.t")).alias(tiebreak)))
    return present.join(best, [*keys, tiebreak], "inner").select(*df.columns)


def packed_argmin(df: DataFrame, keys: Sequence[str], minimise: str, tiebreak: str) -> DataFrame:
    """``keys`` and the ``tiebreak`` of the row with the smallest ``minimise``, then the largest ``tiebreak``.

    Both are whole numbers, |``minimise``| below 2^62 (beyond it the decimal overflows and the job
    fails) and ``tiebreak`` a long.  They are packed in order into one decimal, a buffer of fixed
    width, so the partial aggregate is a hash aggregate; a struct would make it a sort aggregate.
    Rows with a NULL in a key, in ``minimise`` or in ``tiebreak`` take no part.
    """
    cell = F.lit(Decimal(1 << 64))
    turned = F.lit(Decimal((1 << 63) - 1)) - F.col(tiebreak).cast("decimal(19,0)")
    packed = (F.col(minimise).cast("decimal(19,0)") * cell).cast("decimal(38,0)") + turned.cast("decimal(20,0)")
    best = (df.where(all_present(*keys, minimise, tiebreak))
            .groupBy(*keys).agg(F.min(packed.cast("decimal(38,0)")).alias("_best")))
    low = F.pmod(F.col("_best"), cell.cast("decimal(38,0)")).cast("decimal(20,0)")
    return best.select(*keys, (F.lit(Decimal((1 << 63) - 1)) - low).cast("long").alias(tiebreak))


def flag_repeats(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """``out`` = 1 when two or more rows share ``keys`` (all non-NULL), else 0."""
    repeated = (df.where(all_present(*keys)).groupBy(*keys).count()
                .where(F.col("count") > 1).select(*keys, F.lit(1).alias(out)))
    base = df.drop(out) if out in df.columns else df
    return (base.join(repeated, list(keys), "left")
            .select(*base.columns, F.coalesce(F.col(out), F.lit(0)).alias(out)))


def flag_members(df: DataFrame, members: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """``out`` = 1 when the row's ``keys`` occur in ``members``, else 0."""
    found = members.where(all_present(*keys)).select(*keys).distinct().withColumn(out, F.lit(1))
    base = df.drop(out) if out in df.columns else df
    return (base.join(found, list(keys), "left")
            .select(*base.columns, F.coalesce(F.col(out), F.lit(0)).alias(out)))


def flag_repeats_and_members(df: DataFrame, members: DataFrame, keys: Sequence[str], repeats: str, found: str) -> DataFrame:
    """:func:`flag_repeats` and :func:`flag_members` on the same ``keys``, by one grouping and one join.

    Keys of both tables are counted together on narrow rows; only keys with a flag set are joined back.
    """
    rows = (df.select(*keys, F.lit(1).alias("_rows"), F.lit(0).alias("_member"))
            .unionByName(members.select(*keys, F.lit(0).alias("_rows"), F.lit(1).alias("_member"))))
    marks = (rows.where(all_present(*keys)).groupBy(*keys)
             .agg((F.sum("_rows") > 1).cast("int").alias(repeats), F.max("_member").alias(found))
             .where((F.col(repeats) == 1) | (F.col(found) == 1)))
    base = df.drop(repeats, found)
    return (base.join(marks, list(keys), "left")
            .select(*base.columns, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in (repeats, found)]))


def fill_from_group_min(df: DataFrame, keys: Sequence[Column | str], target: str, source: str,
                        fixable: Column) -> DataFrame:
    """Fill NULL ``target`` with the group's earliest ``source``.

    Group = rows with equal ``keys`` (all non-NULL) among the ``fixable`` rows.
    The fill value is ``min(source)`` of the group, used only when a row with a
    NULL ``target`` holds that minimum; every fixable row of the group then gets
    it (also a fixable row whose ``target`` is set).  Only the fixable
    subset is shuffled; the other rows pass through untouched.
    """
    key_cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    names = [f"_k{i}" for i in range(len(key_cols))]
    cand = df.where(fixable)
    keyed = cand.select("*", *[c.alias(n) for c, n in zip(key_cols, names)])
    agg = (keyed.where(all_present(*names)).groupBy(*names)
           .agg(F.min(source).alias("_all_min"),
                F.min(F.when(F.col(target).isNull(), F.col(source))).alias("_null_min"))
           .where(F.col("_all_min") == F.col("_null_min"))
           .select(*names, F.col("_all_min").alias("_fill")))
    fixed = (keyed.join(agg, names, "left")
             .withColumn(target, F.when(F.col("_fill").isNotNull(), F.col("_fill")).otherwise(F.col(target)))
             .select(*df.columns))
    rest = df.where(~fixable | fixable.isNull())
    return fixed.unionByName(rest)

"""Point-in-interval and overlap joins on (key, dyadic node).

Days are numbered from 1900; a node of depth j is one of 2^j equal stretches of
the 2^16 numbered days.  An interval becomes the at most ``2 * depth`` nodes of its
canonical cover, a point its ``depth + 1`` ancestors, and the two share exactly one node if
the point lies in the interval, so (key, node) is a plain equi key and no row meets
all rows of its key.  Open ends are covered like any other interval; days beyond the
numbered ones count as the nearest.  Cells at the greatest depth are met whole, so
the exact condition is still tested on every pair.

Copies cost rows, all pairs of a key cost ``big x small``.  :func:`key_depths` weighs
the two for each key: keys with few pairs stay at depth 0 (one node, one copy, the
plain join), the others get cells of about one row.  Where even the real pairs of one
node exceed ``task_pairs``, :func:`interval_join` splits it with the grid of :mod:`intervals`.

Where no key needs nodes, both sides are dealt by the keys into as many partitions as their rows fill
(:func:`plain_partitions`); groupings by the keys and more columns then need no shuffle of the pairs.
Where some do, the copies are dealt by key and node into as many as the rows and the pairs of those keys fill.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dxlens.operators.intervals import DEFAULT_TASK_PAIRS, hot_key_join, hot_keys

BITS = 16
ORIGIN = "1900-01-01"
# pairs that a copied row saves before copying pays
GAIN = 4 * BITS
_LAST = (1 << BITS) - 1
_OPEN = 1 << 30
# rows of both sides in a partition of the plain join; a plain key has at most GAIN pairs a row
PLAIN_ROWS = 50_000
MOST_PARTITIONS = 4096


def day_number(ts: Column) -> Column:
    return F.datediff(F.to_date(ts), F.lit(ORIGIN).cast("date"))


def _right(x: Column, n) -> Column:
    return F.call_function("shiftright", x, n)


def _left(n) -> Column:
    return F.call_function("shiftleft", F.lit(1), n)


def _clamped(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0)), F.lit(_LAST))


def ancestors(x: Column, depth: Column, tag: int = 0) -> Column:
    """The nodes that hold day ``x``, one of each depth up to ``depth``; none for NULL."""
    at = _clamped(x)
    nodes = F.transform(F.sequence(F.lit(0), depth), lambda j: F.lit(tag) + _left(j) + _right(at, F.lit(BITS) - j))
    return F.when(x.isNotNull(), nodes).otherwise(F.array().cast("array<int>"))


def cover(low: Column, high: Column, depth: Column, tag: int = 0) -> Column:
    """The fewest nodes of at most ``depth`` that cover the days from ``low`` to ``high`` (NULL: without end)."""
    high = F.coalesce(high, F.lit(_OPEN))
    width = F.lit(BITS) - depth
    first, stop = _right(_clamped(low), width), _right(_clamped(high), width) + 1

    def taken(k: Column) -> Column:
        # the stretch in cells of 2^k of the finest: an odd cell at either end has no sibling inside
        l, r = _right(first + _left(k) - 1, k), _right(stop, k)
        base = F.lit(tag) + _left(depth - k)
        return F.array(F.when((l < r) & (l % 2 == 1), base + l), F.when((l < r) & (r % 2 == 1), base + r - 1))

    nodes = F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), depth), taken)))
    return F.when(low <= high, nodes).otherwise(F.array().cast("array<int>"))


@dataclass
class KeyLoads:
    """``depths``: the keys that do not take the plain join; ``split``: whether any of them may need the grid.

    ``partitions``: set if there is no such key; the plain join then deals both sides into so many.
    ``dealt``: set if there is one; the copies are dealt by key and node into so many.
    """

    depths: DataFrame
    split: bool = True
    partitions: int | None = None
    dealt: int | None = None

    @property
    def tasks(self) -> int | None:
        """Partitions that the pairs fill, however they are joined."""
        return self.partitions or self.dealt


def plain_partitions(spark: SparkSession, rows: int) -> int:
    """Partitions of a plain join of ``rows`` rows of both sides."""
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    low, high = min(spark.sparkContext.defaultParallelism, shuffled), max(shuffled, MOST_PARTITIONS)
    return max(low, min(high, rows // PLAIN_ROWS))


def key_depths(big: DataFrame, small: DataFrame, keys: Sequence[str], task_pairs: int = DEFAULT_TASK_PAIRS,
               gain: int = GAIN) -> DataFrame:
    """``keys``, ``_depth``, ``_grid`` of keys with more than ``gain`` pairs a row, or more than ``task_pairs`` pairs."""
    def counted(df, name):
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))

    pairs = F.col("_nb").cast("double") * F.col("_ns")
    many = pairs > gain * (F.col("_nb") + F.col("_ns"))
    depth = F.least(F.lit(BITS), F.ceil(F.log2(F.greatest("_nb", "_ns")))).cast("int")
    return (counted(big, "_nb").join(counted(small, "_ns"), list(keys)).where(many | (pairs > task_pairs))
            .select(*keys, F.when(many, depth).otherwise(0).alias("_depth"), (pairs > task_pairs).alias("_grid")))


def pairs_of(big: DataFrame, small: DataFrame, keys: Sequence[str], depths: DataFrame) -> int:
    """All pairs of the keys in ``depths``, of which a join by nodes forms a part."""
    def counted(df, name):
        return df.join(depths.select(*keys), list(keys), "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias(name))

    pairs = F.sum(F.col("_nb").cast("double") * F.col("_ns"))
    return int(counted(big, "_nb").join(counted(small, "_ns"), list(keys)).agg(pairs).first()[0] or 0)


def with_nodes(df: DataFrame, keys: Sequence[str], depths: DataFrame, nodes: Callable[[Column], Column]) -> DataFrame:
    """A copy of every row for each of its nodes: ``_node``, and ``_grid``."""
    return (df.join(depths, list(keys), "left").withColumn("_depth", F.coalesce("_depth", F.lit(0)))
            .withColumn("_node", F.explode(nodes(F.col("_depth")))).withColumn("_grid", F.coalesce("_grid", F.lit(False)))
            .drop("_depth"))


def interval_join(big: DataFrame, small: DataFrame, keys: Sequence[str], big_nodes: Callable[[Column], Column],
                  small_nodes: Callable[[Column], Column], residual: Column, *, row_id: Sequence[str],
                  small_row_id: Sequence[str], task_pairs: int = DEFAULT_TASK_PAIRS, loads: KeyLoads | None = None) -> DataFrame:
    """Inner join of ``big`` (alias b) and ``small`` (alias s) on ``keys``, a common node and ``residual``.

    ``big_nodes`` / ``small_nodes`` map a depth column to an array of nodes such that rows that
    belong together share one node exactly.  ``loads`` is computed from both sides by default.
    """
    loads = loads or KeyLoads(key_depths(big, small, keys, task_pairs))
    if loads.partitions:
        cond = residual
        for k in keys:
            cond = cond & (F.col(f"b.{k}") == F.col(f"s.{k}"))
        # nodes of depth 0 select the rows that take part
        big = big.withColumn("_node", F.explode(big_nodes(F.lit(0)))).repartition(loads.partitions, *keys)
        small = small.withColumn("_node", F.explode(small_nodes(F.lit(0)))).repartition(loads.partitions, *keys)
        return big.alias("b").join(small.alias("s"), cond)
    big, small = with_nodes(big, keys, loads.depths, big_nodes), with_nodes(small, keys, loads.depths, small_nodes)
    on = [*keys, "_node"]
    if loads.split:
        hot = hot_keys(big.where("_grid"), on, task_pairs, small.where("_grid"))
        return hot_key_join(big.drop("_grid"), small.drop("_grid"), on, residual, row_id=row_id, small_row_id=small_row_id,
                            task_pairs=task_pairs, hot=hot, partitions=loads.dealt)
    cond = residual
    for k in on:
        cond = cond & (F.col(f"b.{k}") == F.col(f"s.{k}"))
    big, small = big.drop("_grid"), small.drop("_grid")
    if loads.dealt:  # explicit, so that copies that pack well are not merged into few partitions of many pairs
        big, small = big.repartition(loads.dealt, *on), small.repartition(loads.dealt, *on)
    return big.alias("b").join(small.alias("s"), cond)

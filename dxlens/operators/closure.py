"""Transitive closure of a directed graph from a seed set.

Breadth-first search, one DataFrame join per level:

    frontier(seed, node) JOIN edges ON edges.parent = frontier.node
      -> (seed, child), child != seed, distinct
      -> left_anti visited ON (seed, child)
      -> new frontier at depth + 1, appended to visited

A pair is first reached at its smallest depth, so visited pairs never need a
second expansion; the result is the least depth over all paths without
enumerating paths, which would explode on a poly-hierarchy.  The search ends, on
cycles too, when a level finds nothing new; ``max_depth`` stops it earlier.  The driver only loops over levels and
asks whether the new level is empty; all rows stay on the executors.

Edges and visited pairs are bucketed tables in the shared checkpoint folder, the edges by parent,
the pairs by (seed, node), in as many buckets as the edges fill (:data:`EDGES_A_BUCKET`), at least one a core and at most
as many as there are shuffle partitions: every level pays for each bucket.  So neither is shuffled
inside the loop: a level shuffles its own rows only, once to the edges and once to the visited
pairs, each time into the same buckets.  A level is one partition (``depth``) of the pairs' table and is appended as
files, which cuts the lineage (an executor loss re-reads stored levels) and
keeps the plan size constant.  The planner broadcasts a table whose stored size is
under the broadcast threshold (a terminology-sized edge table) instead.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dxlens.sources.sinks import delete_path, table_root

EDGES_A_BUCKET = 100_000


class _Search:
    """The stored edges and visited pairs of one closure."""

    def __init__(self, edges: DataFrame, seeds: DataFrame, root: str | None):
        self.spark: SparkSession = edges.sparkSession
        filled = max(edges.count() // EDGES_A_BUCKET, self.spark.sparkContext.defaultParallelism)
        self.buckets = min(filled, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        tag = uuid.uuid4().hex
        self.root = root or f"{table_root(self.spark)}/closure-{tag}"
        self.edge_table, self.pair_table = f"dxlens_edges_{tag}", f"dxlens_pairs_{tag}"
        child, parent, seed = (df.schema[c].dataType.simpleString() for df, c in (
            (edges, "child"), (edges, "parent"), (seeds, "seed")))
        self._create(self.edge_table, f"child {child}, parent {parent}", "", "parent")
        self._create(self.pair_table, f"seed {seed}, node {child}, depth int", "PARTITIONED BY (depth)", "seed, node")

    def _create(self, table: str, columns: str, partitioned: str, keys: str) -> None:
        self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet {partitioned} "
                       f"CLUSTERED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{table}'")

    def store_edges(self, edges: DataFrame) -> None:
        # one shuffle: rows that share a parent meet, and equal rows with them
        edges.repartition(self.buckets, "parent").distinct().select("child", "parent").write.insertInto(self.edge_table)

    @property
    def edges(self) -> DataFrame:
        return self.spark.table(self.edge_table).alias("e")

    def level(self, depth: int) -> DataFrame:
        return self.spark.table(self.pair_table).where(F.col("depth") == depth).select("seed", "node")

    def reached(self, frontier: DataFrame) -> DataFrame:
        """The distinct (seed, child) one edge below ``frontier``."""
        f = frontier.repartition(self.buckets, "node").alias("f")
        return (f.join(self.edges, F.col("f.node") == F.col("e.parent"))
                .select(F.col("f.seed").alias("seed"), F.col("e.child").alias("node"))
                .repartition(self.buckets, "seed", "node").distinct())

    def next_level(self, depth: int) -> DataFrame:
        """Pairs first reached at ``depth``."""
        found = self.reached(self.level(depth - 1)).where(F.col("seed") != F.col("node"))
        visited = self.spark.table(self.pair_table).select("seed", "node")
        return found.join(visited, ["seed", "node"], "left_anti")

    def append(self, pairs: DataFrame, depth: int) -> bool:
        """Store a level; whether it has rows."""
        pairs.select("seed", "node", F.lit(depth).alias("depth")).write.insertInto(self.pair_table)
        return not self.level(depth).isEmpty()

    def pairs(self) -> DataFrame:
        """All stored pairs, read from their files, which outlive the table names."""
        schema = self.spark.table(self.pair_table).schema
        return self.spark.read.schema(schema).parquet(f"{self.root}/{self.pair_table}")

    def close(self) -> None:
        """Forget both names; the pairs' files stay for the result, the edges go."""
        for table in (self.edge_table, self.pair_table):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        delete_path(self.spark, f"{self.root}/{self.edge_table}")


def descendant_closure(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None,
                       child: str = "sourceid", parent: str = "destinationid", seed_col: str = "conceptid",
                       out_ancestor: str = "destinationid", out_descendant: str = "sourceid",
                       out_depth: str = "depth", root: str | None = None) -> DataFrame:
    """All (seed, descendant, min depth), up to ``max_depth`` levels down if given.

    ``edges`` holds the edges to follow (already filtered, e.g. to active is-a
    edges); ``seeds`` the start concepts.  A seed is its own descendant only
    through a self edge at depth 1.  The result reads files below ``root`` (default: a new
    folder of this application's scratch tables).
    """
    e = edges.select(F.col(child).alias("child"), F.col(parent).alias("parent")).where("child IS NOT NULL AND parent IS NOT NULL")
    s = seeds.select(F.col(seed_col).alias("seed")).where(F.col("seed").isNotNull()).distinct()
    search = _Search(e, s, root)
    try:
        search.store_edges(e)
        depth = 1
        more = search.append(search.reached(s.select("seed", F.col("seed").alias("node"))), depth)
        while more and (max_depth is None or depth < max_depth):
            depth += 1
            more = search.append(search.next_level(depth), depth)
        out = search.pairs()
    finally:
        search.close()
    return out.select(F.col("seed").alias(out_ancestor), F.col("node").alias(out_descendant),
                      F.col("depth").cast("int").alias(out_depth))

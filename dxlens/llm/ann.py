"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order, ``prefix`` of them.  An index
shard posts its vectors under their pivots (inverted files: local number and
position).  A query visits the files of its own pivots; the positions met there give the footrule
distance of the two orders, a pivot missing from a prefix counting as position ``prefix``:
with a and b the positions of a shared pivot, the distance falls by 2 (prefix - max(a, b)).
In every shard the best ``share`` by footrule (at least ``min_candidates``) is reranked by exact cosine in double precision, and the shards' best are merged.

A crowd of alike vectors would fill every such share: vectors within an angle of cosine 0.95 of a leader
form one entry, opened wherever the angle bound lets a member be among the best.

The pivots are a bounded sample: the first ``pivots`` vectors, none alike, among the 8 times as many
that come first by a hash of their id.  All
vectors are indexed.  Queries are a stated set, searched in blocks of bounded size.

Edge cases: vectors that are null, zero, of another length than most, or that hold null or non-finite
components take no part, nor do rows without an id; rows with the query's id are never its neighbours; repeated
query rows are searched and numbered each on their own; fewer candidates than ``k`` give fewer
rows; empty tables give none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dxlens.llm.common import Scratch, records
from dxlens.llm.mph import pack, unpack

PIVOTS = 256
DRAWS = 8
SIMILAR = 0.95
PREFIX = 64
SHARE = 0.12
MIN_CANDIDATES = 512
ROWS_PER_SHARD = 4096
QUERY_BLOCK = 4096


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vector as doubles) of the rows that take part."""
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    # NaN and the infinities are not less than infinity in size; a null component makes the test null
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0.0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["n"] if sizes else 0))


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def prefixes(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of each vector's nearest pivots by cosine, nearest first."""
    return np.argsort(-(unit(vectors) @ unit(pivots).T), axis=1, kind="stable")[:, :prefix].astype(np.int32)


def separated(drawn: np.ndarray, count: int, similar: float) -> np.ndarray:
    """The first ``count`` vectors that are not ``similar`` to one taken before."""
    units, taken = unit(drawn), []
    for i in range(len(drawn)):
        if len(taken) == count:
            break
        if not taken or (units[taken] @ units[i]).max() < similar:
            taken.append(i)
    return drawn[taken]


def flocks(units: np.ndarray, nearest_pivot: np.ndarray, similar: float) -> np.ndarray:
    """The leader of each vector: of the vectors with one nearest pivot, the first free one takes all ``similar`` ones."""
    leader = np.full(len(units), -1)
    for pivot in np.unique(nearest_pivot):
        free = np.flatnonzero(nearest_pivot == pivot)
        while len(free):
            taken = units[free] @ units[free[0]] >= similar
            taken[0] = True
            leader[free[taken]] = free[0]
            free = free[~taken]
    return leader


def build(ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, prefix: int, similar: float) -> bytes:
    """One shard: flocks of alike vectors, one entry each, and the inverted files of all pivots end to end.

    A crowd of copies or near copies is one entry under its leader's permutation, so it
    takes one place among the candidates; ``radius`` is the largest angle of a member to the leader.
    """
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    units, orders = unit(vectors), prefixes(vectors, pivots, prefix)
    leader = flocks(units, orders[:, 0], similar)
    by_leader = np.argsort(leader, kind="stable")
    ids, vectors, units, leader = ids[by_leader], vectors[by_leader], units[by_leader], leader[by_leader]
    leaders, owned = np.unique(leader, return_index=True)
    angle = np.arccos(np.clip((units * units[np.repeat(owned, np.diff([*owned, len(ids)]))]).sum(axis=1), -1, 1))
    radius = np.maximum.reduceat(angle, owned)
    orders = orders[leaders]
    member = np.repeat(np.arange(len(leaders), dtype=np.int32), orders.shape[1])
    position = np.tile(np.arange(orders.shape[1], dtype=np.int16), len(leaders))
    pivot = orders.ravel()
    by_pivot = np.argsort(pivot, kind="stable")
    files = np.searchsorted(pivot[by_pivot], np.arange(len(pivots) + 1))
    return pack(ids=ids, vectors=vectors, owned=np.append(owned, len(ids)), radius=radius, files=files,
                member=member[by_pivot], position=position[by_pivot])


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Row by row in a fixed order of addition, so that equal vectors score equally wherever they stand."""
    with np.errstate(over="ignore", invalid="ignore"):
        dots = (vectors * query).sum(axis=1)
        scale = np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum())
        score = dots / scale
    odd = ~np.isfinite(score) | (scale == 0)  # squares beyond the range of doubles: scale first
    if odd.any():
        score[odd] = (unit(vectors[odd]) * unit(query[None])[0]).sum(axis=1)
    return score


def search(shard, query_id: int, query: np.ndarray, order: np.ndarray, k: int, prefix: int, share: float,
           min_candidates: int) -> list[tuple[int, float]]:
    """(id, cosine) of the shard's ``k`` best: candidates by footrule, reranked."""
    files, owned, ids, vectors = shard["files"], shard["owned"], shard["ids"], shard["vectors"]
    entries = len(owned) - 1
    spans = [slice(files[p], files[p + 1]) for p in order]
    members = np.concatenate([shard["member"][s] for s in spans])
    shared = np.concatenate([prefix - np.maximum(shard["position"][s], a) for a, s in enumerate(spans)])
    overlap = np.bincount(members, weights=shared, minlength=entries)
    wanted = max(min_candidates, int(np.ceil(share * entries)))
    # smaller is nearer: the footrule distance is a constant less twice the overlap
    near = np.argpartition(-overlap, wanted - 1)[:wanted] if wanted < entries else np.arange(entries)
    first = owned[near]
    score = cosines(vectors[first], query)
    alone = np.flatnonzero((owned[near + 1] - first == 1) & (ids[first] != query_id))
    best = alone[np.lexsort((ids[first[alone]], -score[alone]))[:k]]
    hits = [(int(ids[first[i]]), float(score[i])) for i in best]
    # a member is at most ``radius`` nearer in angle than its leader: flocks are opened while that can matter
    crowds = np.flatnonzero(owned[near + 1] - first > 1)
    reach = np.cos(np.maximum(0, np.arccos(np.clip(score[crowds], -1, 1)) - shard["radius"][near[crowds]] - 1e-7))
    for i in np.argsort(-reach, kind="stable"):
        if len(hits) == k and reach[i] < hits[-1][1]:
            break
        held = slice(owned[near[crowds[i]]], owned[near[crowds[i]] + 1])
        others = ids[held] != query_id
        found = cosines(vectors[held][others], query)
        best = np.lexsort((ids[held][others], -found))[:k]
        hits += [(int(ids[held][others][j]), float(found[j])) for j in best]
        hits = sorted(hits, key=lambda hit: (-hit[1], hit[0]))[:k]
    return hits


def query_blocks(queries: DataFrame, size: int) -> Iterator[list[tuple[int, list[float]]]]:
    """The queries in blocks of at most ``size``, one block on the driver at a time."""
    block = []
    for row in queries.toLocalIterator():
        block.append((row["id"], row["v"]))
        if len(block) >= size:
            yield block
            block = []
    if block:
        yield block


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", vector_column: str = "embedding",
            pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE, min_candidates: int = MIN_CANDIDATES,
            rows_per_shard: int = ROWS_PER_SHARD, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query row, by cosine, nearest first."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    rows = scratch.table(usable(vectors, id_column, vector_column), "rows")
    dimensions = rows.limit(1).select(F.size("v")).collect()
    asked = usable(queries, id_column, vector_column).where(F.size("v") == (dimensions[0][0] if dimensions else 0))
    drawn = rows.orderBy(F.xxhash64("id"), "id", "v").limit(DRAWS * pivots).collect()
    chosen = separated(np.array([r["v"] for r in drawn] or np.zeros((0, 1))), pivots, SIMILAR)
    prefix = min(prefix, len(chosen))
    shards = max(1, -(-rows.count() // rows_per_shard))

    def index(batches):
        found = [b for b in batches if b.num_rows]
        if found:
            table = pa.Table.from_batches(found).combine_chunks()
            flat = table["v"].chunk(0).flatten().to_numpy().reshape(len(table), -1)
            yield pa.RecordBatch.from_arrays([pa.array([build(table["id"].to_numpy(), flat, chosen, prefix, SIMILAR)], pa.binary())], names=["arrays"])

    stored = scratch.table(rows.repartition(shards).mapInArrow(index, "arrays binary"), "index")
    result = spark.createDataFrame([], "query_row long, query_id long, vec_id long, score double")
    done = 0
    for block in query_blocks(asked, query_block):
        sent = spark.sparkContext.broadcast(([q for q, _ in block], np.array([v for _, v in block]), chosen))

        def look(batches, sent=sent, done=done):
            ids, points, pivot_vectors = sent.value
            orders = prefixes(points, pivot_vectors, prefix)
            for (arrays,) in records(batches):
                loaded = unpack(arrays)
                shard = {name: loaded[name] for name in ("ids", "vectors", "owned", "radius", "files", "member", "position")}
                out = [(done + i, q, *hit) for i, (q, point, order) in enumerate(zip(ids, points, orders))
                       for hit in search(shard, q, point, order, k, prefix, share, min_candidates)]
                columns = list(zip(*out)) or [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
                     pa.array(columns[3], pa.float64())], names=["query_row", "query_id", "vec_id", "score"])

        tasks = min(shards, 4 * spark.sparkContext.defaultParallelism)
        result = result.unionByName(stored.repartition(tasks).mapInArrow(look, result.schema))
        done += len(block)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return (result.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
